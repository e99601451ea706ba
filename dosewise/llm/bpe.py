"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

**Encoding.** A piece's tokens are those of the greedy lowest-rank merge. Two facts make a left-to-right machine of it:
a token sequence is such a result exactly if every adjacent pair is the result for its own bytes, so each prefix has
one last token; and a token can start only where some vocabulary entry still matches. A state therefore holds the
positions at which an entry may still be running (its place in the vocabulary's trie), the last token of each, and how
they hang together. A byte moves all of them at once; tokens on which all live positions agree are emitted, the others
wait, for at most the length of the longest entry. States and moves are made when first met and kept (the
determinisation is lazy); once the table is full, unseen moves run without making states. Pair tests are remembered.

**Decoding** joins the token bytes and cuts the stream where a UTF-8 state machine is between characters.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_rows, quoted, text_bytes

#: States that a worker keeps, and remembered pieces after which it starts anew: bounds of its memory, not of the result.
MAX_STATES = 40_000
MAX_PIECES = 600_000
#: Ids that the decoder takes at once.
DECODE_STEP = 4096


class MergeTransducer:
    """Encode pieces (bytes) by merge ranks.

    ``ranks`` maps token bytes to ids; all 256 single bytes must be among them.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._kids: list[dict[int, int]] = [{}]  # the trie: of each node the next by byte
        self._token = [-1]  # the entry that ends at a node
        for token, rank in ranks.items():
            at = 0
            for byte in token:
                after = self._kids[at].get(byte)
                if after is None:
                    after = self._kids[at][byte] = len(self._kids)
                    self._kids.append({})
                    self._token.append(-1)
                at = after
            self._token[at] = rank
        self._pairs: dict[int, bool] = {}
        # an entry of a state: (index of the entry its last token starts from, last token, trie node or -1)
        start = ((-1, -1, 0),)
        self._states = [start]
        self._number = {start: 0}
        self._moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self._ends: dict[int, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> list[int]:
        """The defining procedure, for short byte strings: join the adjacent pair of lowest rank, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _fits(self, left: int, right: int) -> bool:
        """Whether the bytes of both encode to just these two; left is -1 at the start of a piece."""
        known = self._pairs.get(left << 32 | right)
        if known is None:
            known = self.merge((self.bytes_of[left] if left >= 0 else b"") + self.bytes_of[right]) == ([left, right] if left >= 0 else [right])
            self._pairs[left << 32 | right] = known
        return known

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Make and keep the move of a state."""
        moved, added = [], None
        for i, (parent, token, node) in enumerate(self._states[state]):
            if node >= 0:
                node = self._kids[node].get(byte, -1)
                if added is None and node >= 0 and (found := self._token[node]) >= 0 and self._fits(token, found):
                    added = (i, found, 0)
            moved.append((parent, token, node))
        moved.append(added)
        size = len(moved)
        children = [0] * size  # of the entries that are needed: alive, or before one that is
        needed = []
        for i in range(size - 1, -1, -1):
            parent, _, node = moved[i]
            if node >= 0 or children[i]:
                needed.append(i)
                if parent >= 0:
                    children[parent] += 1
        needed.reverse()
        # all live paths agree up to the last entry that each of them passes through
        first, emitted = 0, []
        while moved[needed[first]][2] < 0 and children[needed[first]] == 1:
            first += 1
            emitted.append(moved[needed[first]][1])
        kept = needed[first:]
        place = {i: n for n, i in enumerate(kept)}
        new = tuple((place.get(moved[i][0], -1), moved[i][1], moved[i][2]) for i in kept)
        number = self._number.get(new)
        if number is None:
            number = self._number[new] = len(self._states)
            self._states.append(new)
        move = self._moves[state << 8 | byte] = (number, tuple(emitted))
        return move

    def _simulate(self, state: int, rest: bytes) -> list[int]:
        """What is left of a piece after ``state``, without making states: the table is full."""
        kids, tokens, pairs = self._kids, self._token, self._pairs
        entries = self._states[state]
        parents, last = [e[0] for e in entries], [e[1] for e in entries]
        live = [(i, e[2]) for i, e in enumerate(entries) if e[2] >= 0]
        for byte in rest:
            live = [(i, after) for i, node in live if (after := kids[node].get(byte))]
            for i, node in live:
                found = tokens[node]
                if found >= 0:
                    fits = pairs.get(last[i] << 32 | found)
                    if self._fits(last[i], found) if fits is None else fits:
                        live.append((len(last), 0))
                        parents.append(i)
                        last.append(found)
                        break
            else:
                raise ValueError("the vocabulary lacks a single byte")
        path, at = [], len(last) - 1
        while at > 0:
            path.append(last[at])
            at = parents[at]
        path.reverse()
        return path

    def _end(self, state: int) -> tuple[int, ...]:
        path, entries = [], self._states[state]
        at = len(entries) - 1
        while at > 0:
            path.append(entries[at][1])
            at = entries[at][0]
        ids = self._ends[state] = tuple(reversed(path))
        return ids

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece; a piece that is itself an entry is that entry."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, out, moves = 0, [], self._moves
        for at, byte in enumerate(piece):
            move = moves.get(state << 8 | byte)
            if move is None:
                if len(self._states) > MAX_STATES:
                    return out + self._simulate(state, piece[at:])
                move = self._move(state, byte)
            state, emitted = move
            if emitted:
                out += emitted
        ends = self._ends.get(state)
        out += ends if ends is not None else self._end(state)
        return out


class TextEncoder:
    """Encode whole texts: split by ``pattern``, each match encoded separately.

    Lines and words come back often, so their ids are remembered as packed bytes. A text is first cut at single spaces
    and line feeds between characters that are no white space: a match never crosses such a space from the left and never
    holds such a line feed with anything else. Texts with any other white space around are split by the pattern as a whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine = MergeTransducer(ranks)
        self.find = regex.compile(pattern).findall
        self._first: dict[str, bytes | None] = {}
        self._later: dict[str, bytes | None] = {}
        self._pieces: dict[str, bytes] = {}
        self._cuts = self._can_cut(pattern)
        self._line_feed = self._packed("\n")

    @staticmethod
    def _can_cut(pattern: str) -> bool:
        """Test the cutting rule on the pattern itself with short texts of every kind of neighbour."""
        find = regex.compile(pattern).findall
        kinds = ["a", "é", "7", "!", "'s", "a7", "!a", "'"]
        if any(find(left + mark) != [*find(left), mark] for left in ("a", "é", "7", "a7", "中") for mark in ".,!"):
            return False
        for left in kinds:
            for right in kinds:
                if find(f"{left} {right}") != find(left) + find(f" {right}") or find(f"{left}\n{right}") != [*find(left), "\n", *find(right)]:
                    return False
        return True

    def _packed(self, text: str) -> bytes:
        out = []
        for piece in self.find(text):
            known = self._pieces.get(piece)
            if known is None:
                if len(self._pieces) > MAX_PIECES:
                    self._pieces.clear()
                known = array("I", self.machine.encode(piece.encode())).tobytes()
                if len(piece) <= 64:
                    self._pieces[piece] = known
            out.append(known)
        return b"".join(out)

    def _word(self, word: str, table: dict[str, bytes | None], before: str) -> bytes | None:
        """Ids of a word that the table lacks; None if it touches other white space."""
        if not word or word[0].isspace() or word[-1].isspace():
            ids = None
        elif word[-1] in ".,!" and word[:-1].isalnum():  # the pattern parts them, as _can_cut() has tested
            stem = table.get(word[:-1])
            ids = (stem or self._word(word[:-1], table, before)) + self._packed(word[-1])
        else:
            ids = self._encoded(before + word)
        if len(table) > MAX_PIECES:
            table.clear()
        if len(word) <= 64:
            table[word] = ids
        return ids

    def _encoded(self, text: str) -> bytes:
        ids = []
        for piece in self.find(text):
            ids += self.machine.encode(piece.encode())
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        if not self._cuts:
            return self._packed(text)
        out, first, later = [], self._first, self._later
        missing = object()
        for n, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if n:
                out.append(self._line_feed)
            ids = first.get(words[0], missing)
            if ids is missing:
                ids = self._word(words[0], first, "")
            if ids is None:
                return self._packed(text)
            out.append(ids)
            start = len(out)
            out += [later.get(word, missing) for word in words[1:]]
            for i in range(start, len(out)):
                if out[i] is missing:
                    out[i] = self._word(words[i - start + 1], later, " ")
                if out[i] is None:
                    return self._packed(text)
        return b"".join(out)


# States of the UTF-8 machine: 0 between characters, 1-3 so many continuation bytes to come, 4-7 the lead bytes with a
# narrower second byte (E0, ED, F0, F4), 8 not UTF-8. Fixed by the definition of UTF-8.
_ASIDE = {0xE0: 4, 0xED: 5, 0xF0: 6, 0xF4: 7}
_SECOND = {4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}


def utf8_step(state: int, byte: int) -> int:
    if state == 0:
        if byte < 0x80:
            return 0
        if byte in _ASIDE:
            return _ASIDE[byte]
        return 1 if 0xC2 <= byte <= 0xDF else 2 if 0xE1 <= byte <= 0xEF else 3 if 0xF1 <= byte <= 0xF3 else 8
    if state in _SECOND:
        low, high, then = _SECOND[state]
        return then if low <= byte <= high else 8
    return state - 1 if state < 8 and 0x80 <= byte <= 0xBF else 8


class StreamDecoder:
    """Turn ids into text as they come; bytes of an unfinished character wait, bytes that are no UTF-8 become U+FFFD."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.waiting = b""

    def push(self, ids: Iterable[int]) -> str:
        data = self.waiting + b"".join(map(self.bytes_of.__getitem__, ids))
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            if data[cut - back] & 0xC0 != 0x80:  # the last byte that can begin a character
                state = 0
                for byte in data[cut - back :]:
                    state = utf8_step(state, byte)
                cut -= back if 0 < state < 8 else 0
                break
        self.waiting = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.waiting = self.waiting.decode("utf-8", "replace"), b""
        return rest


def load_ranks(path: str) -> dict[bytes, int]:
    """Read a rank file: a base64 token and its id per line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file) if token}


_ENCODERS: dict[tuple[str, str], TextEncoder] = {}


def encoder(ranks_path: str, pattern: str) -> TextEncoder:
    """The encoder of a worker; its tables serve all tasks that the worker runs."""
    key = (ranks_path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = TextEncoder(load_ranks(ranks_path), pattern)
    return _ENCODERS[key]


def decode_bytes(decoder: StreamDecoder, ids: bytes) -> Iterable[str]:
    values = np.frombuffer(ids, "<u4").tolist()
    for at in range(0, len(values), DECODE_STEP):
        yield decoder.push(values[at : at + DECODE_STEP])
    yield decoder.finish()


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (packed little-endian unsigned 32-bit) of every whole text.

    The rank file is read where the tasks run, from a path that all machines have. Null and empty texts have no ids; rows
    are independent, so repeated rows and null keys give a row each; other columns are not carried.
    """

    def make():
        coder = encoder(ranks_path, pattern)
        return lambda key, text: (key, coder.encode(text.decode("utf-8", "replace")))

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(docs[quoted(id_col)].alias("doc_id"), text_bytes(text_col).alias("text")), f"doc_id {kind}, ids binary", make)


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from packed ids, read as a stream; null ids give an empty text, an unknown id fails."""

    def make():
        bytes_of = {rank: token for token, rank in load_ranks(ranks_path).items()}
        return lambda key, ids: (key, "".join(decode_bytes(StreamDecoder(bytes_of), ids or b"")))

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_rows(encoded.select(encoded[quoted(id_col)].alias("doc_id"), encoded[quoted(ids_col)].alias("ids")), f"doc_id {kind}, text string", make)


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256``: as :func:`encode`, with the digest of the text that the ids give when decoded."""

    def make():
        coder = encoder(ranks_path, pattern)

        def row(key, text):
            ids = coder.encode(text.decode("utf-8", "replace"))
            seen = hashlib.sha256()
            for part in decode_bytes(StreamDecoder(coder.machine.bytes_of), ids):
                seen.update(part.encode())
            return key, len(ids) // 4, ids, seen.hexdigest()

        return row

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids binary, decoded_sha256 string"
    return map_rows(docs.select(docs[quoted(id_col)].alias("doc_id"), text_bytes(text_col).alias("text")), schema, make)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text in one pass: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""

    def make():
        coder = encoder(ranks_path, pattern)

        def row(key, text):
            ids = coder.encode(text.decode("utf-8", "replace"))
            seen = hashlib.sha256()
            for part in decode_bytes(StreamDecoder(coder.machine.bytes_of), ids):
                seen.update(part.encode())
            return key, len(ids) // 4, hashlib.sha256(ids).hexdigest(), seen.hexdigest()

        return row

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_rows(docs.select(docs[quoted(id_col)].alias("doc_id"), text_bytes(text_col).alias("text")), schema, make)
