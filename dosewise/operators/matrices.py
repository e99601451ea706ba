"""What a fit asks of a matrix, of dense rows and of rows that are mostly 0.

A sparse row is ``struct<width, one, places, values, target>``: the row ``[one, x, target]`` of ``width`` features ``x``, of which the
places of those other than 0 and their values are kept. A table of such rows is turned into columns once; centring and scaling
are folded into every product, so nothing is ever as large as rows x features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

ROW = "struct<width:int,one:double,places:array<int>,values:array<double>,target:double>"
#: Cells handled at once, and bytes of a block of dense columns.
_CELLS, _BLOCK_BYTES = 1 << 18, 16 << 20


class Dense:
    """A matrix as an array."""

    def __init__(self, x: np.ndarray):
        self.x, self.shape = x, x.shape

    def squares(self) -> np.ndarray:
        return np.einsum("ij,ij->j", self.x, self.x)

    def take(self, places: np.ndarray) -> Dense:
        return Dense(np.asfortranarray(self.x[:, places]))

    def column(self, j: int) -> np.ndarray:
        return self.x[:, j]

    def dot(self, w: np.ndarray) -> np.ndarray:
        kept = np.flatnonzero(w)
        return self.x[:, kept] @ w[kept]

    def pull(self, r: np.ndarray) -> np.ndarray:
        return self.x.T @ r

    def outer(self) -> np.ndarray:
        return self.x @ self.x.T

    def products(self, left: list[int], right: list[int]) -> np.ndarray:
        return self.x[:, left].T @ self.x[:, right]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0] + 1, …`` for each length in turn."""
    ends = np.cumsum(lengths)
    out = np.repeat(starts - ends + lengths, lengths)
    out += np.arange(len(out))
    return out


def distinct(sizes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entry of each cell in a table of the different values of each row; the entries' rows and values."""
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    order = np.lexsort((values, row))
    ordered, own = values[order], row[order]
    new = np.append(True, (np.diff(own) != 0) | (ordered[1:] != ordered[:-1]))[: len(order)]
    entry = np.empty(len(order), np.int32)
    entry[order] = np.cumsum(new) - 1
    return entry, own[new], ordered[new]


#: Cells per row, places, entries of the cells, rows and values of the entries.
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class Cells:
    """The cells other than 0 by column, those of column ``j`` at ``starts[j]`` to ``starts[j + 1]``. A cell is an entry in a table of
    the different values of each row: four bytes where the same values come often."""

    def __init__(self, n: int, starts: np.ndarray, entries: np.ndarray, rows: np.ndarray, values: np.ndarray):
        self.n, self.starts, self.entries, self.rows, self.values = n, starts, entries, rows, values
        self._filled = np.flatnonzero(np.diff(starts))

    @staticmethod
    def of(blocks: Callable[[], Iterator[Block]], n: int, width: int) -> Cells:
        """From blocks of cells by row, which are gone through twice and dealt to the columns one after the other."""
        counts = np.zeros(width, np.int64)
        for _, places, *_ in blocks():
            counts += np.bincount(places, minlength=width)
        starts = np.concatenate([[0], np.cumsum(counts)])
        entries, following = np.empty(starts[-1], np.int32), starts[:-1].copy()
        rows, values, before, held = [np.zeros(0, np.int32)], [np.zeros(0)], 0, 0
        for sizes, places, entry, own_rows, own_values in blocks():
            order = np.argsort(places, kind="stable")
            ordered = places[order]
            begins = np.flatnonzero(np.diff(ordered, prepend=-1))
            lengths = np.diff(begins, append=len(ordered))
            found = ordered[begins]
            entries[_ranges(following[found], lengths)] = entry[order] + held
            following[found] += lengths
            rows.append((own_rows + before).astype(np.int32))
            values.append(own_values)
            before, held = before + len(sizes), held + len(own_rows)
        return Cells(n, starts, entries, np.concatenate(rows), np.concatenate(values))

    def sums(self, r: np.ndarray, each=None) -> np.ndarray:
        """``x'r`` of every column, or the sums of ``each(column, value, r of its row)``."""
        out = np.zeros(len(self.starts) - 1)
        weights = r[self.rows] if each else self.values * r[self.rows]
        firsts, at = self.starts[self._filled], 0
        while at < len(firsts):
            end = max(at + 1, int(np.searchsorted(firsts, firsts[at] + _CELLS, "left")))
            own = self._filled[at:end]
            part = self.entries[firsts[at] : self.starts[own[-1] + 1]]
            found = weights[part]
            if each is not None:
                found = each(np.repeat(own, self.starts[own + 1] - self.starts[own]), self.values[part], found)
            out[own] = np.add.reduceat(found, firsts[at:end] - firsts[at])
            at = end
        return out

    def take(self, places: np.ndarray, live: np.ndarray | None = None) -> Cells:
        """Some columns, and of their cells those in live rows."""
        lengths = self.starts[places + 1] - self.starts[places]
        entries = self.entries[_ranges(self.starts[places], lengths)]
        if live is not None:
            kept = live[self.rows[entries]]
            column = np.repeat(np.arange(len(places)), lengths)
            entries, lengths = entries[kept], np.bincount(column[kept], minlength=len(places))
        return Cells(self.n, np.concatenate([[0], np.cumsum(lengths)]), entries, self.rows, self.values)

    def dot(self, w: np.ndarray) -> np.ndarray:
        kept = np.flatnonzero(w)
        own = self.take(kept) if len(kept) < len(w) else self
        each = np.bincount(own.entries, np.repeat(w[kept], np.diff(own.starts)), minlength=len(self.rows))
        return np.bincount(self.rows, each * self.values, minlength=self.n)

    def dense(self) -> np.ndarray:
        out = np.zeros((len(self.starts) - 1, self.n))
        out[np.repeat(np.arange(len(out)), np.diff(self.starts)), self.rows[self.entries]] = self.values[self.entries]
        return out.T

    def moments(self, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Means of the rows whose ``one`` is other than 0, and sums of the squares around them; rows of ``one`` 0 count whole."""
        n = float(one @ one)
        mean = self.sums(one) / n
        return mean, self.around(one, mean, None)

    def around(self, one: np.ndarray, mean: np.ndarray, live: np.ndarray | None) -> np.ndarray:
        """Sums over live rows of ``(x - one * mean)**2``. Rows without a cell in a column are ``one * mean`` apart."""
        apart = self.sums(one, lambda column, value, own: (value - own * mean[column]) ** 2)
        if live is not None:  # cells of other rows have ``one`` 0 and are taken out again
            apart -= self.sums((~live).astype(float), lambda column, value, out: value**2 * out)
        held = self.sums(one, lambda column, value, own: own**2)
        return np.maximum(apart, 0.0) + mean**2 * np.maximum(float(one @ one) - held, 0.0)


class Sparse:
    """``(x - one * mean) / scale`` of the live rows of some cells; other rows are 0."""

    def __init__(self, cells: Cells, one: np.ndarray, mean: np.ndarray, scale: np.ndarray, live: np.ndarray | None = None):
        self.cells, self.mean, self.scale, self.live = cells, mean, scale, live
        self.one = one if live is None else one * live
        self.shape = (int(live.sum()) if live is not None else cells.n, len(mean))

    def squares(self) -> np.ndarray:
        return self.cells.around(self.one, self.mean, self.live) / self.scale**2

    def take(self, places: np.ndarray) -> Sparse:
        own = Sparse(self.cells.take(places, self.live), self.one, self.mean[places], self.scale[places])
        own.shape = (self.shape[0], len(places))
        return own

    def column(self, j: int) -> np.ndarray:
        return self._block(np.array([j]))[:, 0]

    def dot(self, w: np.ndarray) -> np.ndarray:
        scaled = w / self.scale
        out = self.cells.dot(scaled)
        return (out if self.live is None else out * self.live) - self.one * (self.mean @ scaled)

    def pull(self, r: np.ndarray) -> np.ndarray:
        """Of an ``r`` that is 0 where rows are not live."""
        return (self.cells.sums(r) - self.mean * (self.one @ r)) / self.scale

    def _block(self, places: np.ndarray) -> np.ndarray:
        """Some columns in full."""
        full = self.cells.take(places, self.live).dense()
        for k, place in enumerate(places.tolist()):
            full[:, k] -= self.one * self.mean[place]
            full[:, k] /= self.scale[place]
        return full

    def _slices(self, places: np.ndarray) -> list[np.ndarray]:
        step = max(8, _BLOCK_BYTES // (8 * max(1, self.cells.n)))
        return [places[at : at + step] for at in range(0, len(places), step)]

    def outer(self) -> np.ndarray:
        out = np.zeros((self.cells.n, self.cells.n))
        for part in self._slices(np.arange(self.shape[1])):
            block = self._block(part)
            out += block @ block.T
        return out

    def products(self, left: list[int], right: list[int]) -> np.ndarray:
        left, right = np.asarray(left, np.int64), np.asarray(right, np.int64)
        out, at = np.empty((len(left), len(right))), 0
        for part in self._slices(right):
            block, to = self._block(part), 0
            for other in self._slices(left):
                out[to : to + len(other), at : at + len(part)] = self._block(other).T @ block
                to += len(other)
            at += len(part)
        return out


def lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and flat values of a list column."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks)
    return np.diff(whole.offsets.to_numpy()).astype(np.int64), whole.flatten().to_numpy(zero_copy_only=False)


def struct_rows(width: int, one: np.ndarray, sizes: np.ndarray, places: np.ndarray, values: np.ndarray, target: np.ndarray) -> pa.StructArray:
    """Sparse rows as an Arrow column."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    columns = [
        pa.array(np.full(len(sizes), width, np.int32)),
        pa.array(one),
        pa.ListArray.from_arrays(offsets, pa.array(places.astype(np.int32, copy=False))),
        pa.ListArray.from_arrays(offsets, pa.array(values)),
        pa.array(target),
    ]
    return pa.StructArray.from_arrays(columns, names=["width", "one", "places", "values", "target"])


def full_rows(width: int, one: np.ndarray, sizes: np.ndarray, places: np.ndarray, values: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``[one, x, target]`` as an array."""
    out = np.zeros((len(sizes), width + 2))
    out[:, 0], out[:, -1] = one, target
    out[np.repeat(np.arange(len(sizes)), sizes), places.astype(np.int64) + 1] = values
    return out
