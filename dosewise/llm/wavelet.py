"""Token ids in wavelet-matrix shards.

A shard holds the ids of consecutive documents (ascending id) as a wavelet matrix: the ids are replaced by their rank
among the shard's distinct ids, and of each bit of the ranks there is one plane; after a plane the zeros go before the
ones, in order. With the number of ones before every 512th bit, ``access``, ``rank`` and ``select`` need one look-up per
plane, without unpacking the ids.

Shards are rows of a Parquet table that Spark writes and commits, a file per task, so a lost executor or a second attempt
leaves no broken file behind. The payload's format is given at :meth:`Wavelet.pack`.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_schema, quoted, text_bytes

MAGIC = b"WVM1"
BLOCK = 512  # bits between two entries of the directory
#: Ids after which a task closes a shard.
SHARD_TOKENS = 1 << 20
#: Words that a worker remembers before it starts anew.
MAX_WORDS = 1_000_000
#: Marks that a splitter keeps apart from the letter or digit before them.
_MARKS = b".,!?;:#*$%&|<>()[]{}+=/\"-"
#: Latin letters end before this character.
_LATIN_END = 0x180
_LATIN_LAST = chr(_LATIN_END)


def _byte_characters() -> dict[int, str]:
    """The characters by which byte-level tokenizers write bytes: printable Latin-1 as it is, the others from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + n) for n, b in enumerate(hidden)}


_BYTE_CHARACTERS = _byte_characters()

SHARD_SCHEMA = "part int, first_start bigint, n_docs bigint, n_tokens bigint, shard binary"


class Wavelet:
    """A wavelet matrix over ids, built or read back."""

    def __init__(self, size: int, alphabet: np.ndarray, zeros: list[int], planes: list[np.ndarray], directory: list[np.ndarray]):
        self.size, self.alphabet, self.zeros, self.planes, self.directory = size, alphabet, zeros, planes, directory

    @classmethod
    def build(cls, ids: np.ndarray) -> Wavelet:
        top = int(ids.max()) + 1 if len(ids) else 0
        seen = np.bincount(ids, minlength=top) > 0 if len(ids) else np.zeros(0, bool)
        alphabet = np.flatnonzero(seen).astype("<u4")
        ranks = np.zeros(top, np.uint32)
        ranks[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
        current = ranks[ids].astype(np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        bits = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 0
        zeros, planes, directory = [], [], []
        for bit in range(bits - 1, -1, -1):
            ones = (current & current.dtype.type(1 << bit)) != 0
            plane = np.packbits(ones, bitorder="little")
            planes.append(plane)
            directory.append(cls._directory(plane))
            low = np.flatnonzero(~ones)
            zeros.append(len(low))
            current = np.concatenate((current.take(low), current.take(np.flatnonzero(ones))))
        return cls(len(ids), alphabet, zeros, planes, directory)

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        """Ones before every block of BLOCK bits."""
        padded = np.zeros(-(-max(len(plane), 1) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
        padded[: len(plane)] = plane
        counts = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
        return np.concatenate(([0], np.cumsum(counts))).astype("<u4")

    def all(self) -> np.ndarray:
        """All ids in order, plane by plane from the last to the first."""
        kind = np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32
        current = np.zeros(self.size, kind)
        for level in range(len(self.planes) - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.size, bitorder="little").view(bool)
            before = np.empty_like(current)
            cut = self.zeros[level]
            before[np.flatnonzero(~ones)] = current[:cut]
            before[np.flatnonzero(ones)] = current[cut:] | kind(1 << (len(self.planes) - 1 - level))
            current = before
        return self.alphabet[current] if self.size else np.zeros(0, "<u4")

    def _ones(self, level: int, at: int) -> int:
        """Ones of a plane before position ``at``."""
        plane, block = self.planes[level], at // BLOCK
        part = plane[block * BLOCK // 8 : at // 8]
        rest = int(plane[at // 8]) & ((1 << at % 8) - 1) if at % 8 else 0
        return int(self.directory[level][block]) + int(np.bitwise_count(part).sum()) + rest.bit_count()

    def access(self, at: int) -> int:
        """The id at a position."""
        if not 0 <= at < self.size:
            raise IndexError(at)
        value = 0
        for level, plane in enumerate(self.planes):
            one = int(plane[at // 8]) >> at % 8 & 1
            ones = self._ones(level, at)
            at = self.zeros[level] + ones if one else at - ones
            value = value << 1 | one
        return int(self.alphabet[value])

    def _code(self, token: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def _range(self, code: int, start: int, end: int) -> tuple[int, int]:
        """Where the occurrences among positions start to end lie after the last plane."""
        for level in range(len(self.planes)):
            a, b = self._ones(level, start), self._ones(level, end)
            if code >> (len(self.planes) - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def rank(self, token: int, end: int) -> int:
        """Occurrences of an id before position ``end``."""
        return self.count(token, 0, end)

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id from ``start`` up to ``end``."""
        code = self._code(token)
        if code is None:
            return 0
        first, last = self._range(code, start, self.size if end is None else end)
        return last - first

    def select(self, token: int, nth: int) -> int:
        """Position of the nth occurrence of an id, from 0; -1 if there is none."""
        code = self._code(token)
        if code is None:
            return -1
        first, last = self._range(code, 0, self.size)
        if not 0 <= nth < last - first:
            return -1
        at = first + nth
        for level in range(len(self.planes) - 1, -1, -1):
            one = code >> (len(self.planes) - 1 - level) & 1
            at = self._select_bit(level, one, at - self.zeros[level] if one else at)
        return at

    def _select_bit(self, level: int, one: int, nth: int) -> int:
        ones = self.directory[level]
        before = ones if one else np.arange(len(ones), dtype=np.int64) * BLOCK - ones
        block = int(np.searchsorted(before, nth, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == one)[nth - int(before[block])])

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, n) for n in range(self.count(token))]

    def pack(self, doc_ids: list[int | None], offsets: np.ndarray) -> bytes:
        """Bytes of a shard, all numbers little-endian.

        ``WVM1``; u32 documents, u64 ids, u32 distinct ids, u32 planes; per document i64 id; one bit per document that
        tells a null id (packed, low bit first); u64 offsets of the documents' first ids and the end; u32 distinct ids
        ascending; per plane u64 zeros, its directory (u32 per block of 512 bits and the end) and its bits, low first.
        """
        missing = np.packbits([d is None for d in doc_ids], bitorder="little").tobytes() if doc_ids else b""
        parts = [MAGIC, struct.pack("<IQII", len(doc_ids), self.size, len(self.alphabet), len(self.planes))]
        parts += [np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), missing, offsets.astype("<u8").tobytes(), self.alphabet.astype("<u4").tobytes()]
        for zeros, directory, plane in zip(self.zeros, self.directory, self.planes, strict=True):
            parts += [struct.pack("<Q", zeros), directory.astype("<u4").tobytes(), plane.tobytes()]
        return b"".join(parts)

    @classmethod
    def unpack(cls, data: bytes) -> tuple[Wavelet, list[int | None], np.ndarray]:
        """The matrix, document ids and offsets of a shard."""
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        n_docs, size, n_alphabet, n_planes = struct.unpack_from("<IQII", data, 4)
        at = 24

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            values = np.frombuffer(data, kind, count, at)
            at += values.nbytes
            return values

        ids = take("<i8", n_docs).tolist()
        missing = np.unpackbits(take("u1", -(-n_docs // 8)), count=n_docs, bitorder="little")
        doc_ids = [None if m else d for d, m in zip(ids, missing, strict=True)]
        offsets, alphabet = take("<u8", n_docs + 1), take("<u4", n_alphabet)
        zeros, planes, directory = [], [], []
        for _ in range(n_planes):
            zeros.append(int(take("<u8", 1)[0]))
            n_bytes = -(-size // 8)
            directory.append(take("<u4", -(-max(n_bytes, 1) // (BLOCK // 8)) + 1))
            planes.append(take("u1", n_bytes))
        return cls(size, alphabet, zeros, planes, directory), doc_ids, offsets


class WordIds:
    """Ids of whole texts by a ``tokenizers`` file whose normaliser and splitter keep words apart at white space.

    Such a tokenizer gives for a text the ids of its ASCII-white-space-separated words one after the other (white space is
    dropped, and neither the normal form nor a match crosses it), so the library encodes each distinct word once. What else
    saves look-ups, lower case, the last marks apart and Latin letters as one piece, is probed, and done only where it holds.
    Control strings inside texts get the ids that the library gives them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        controls = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.has_control = re.compile(b"|".join(map(re.escape, controls)) or b"(?!)", re.IGNORECASE).search
        probe = ["Abc, déf's", "x y", "e ́a", *[f"{c.decode()} a{c.decode()}b." for c in controls]]
        whole = self._library([" \n".join(probe)])[0]
        if whole != [i for word in " ".join(probe).split(" ") for i in self._library([word])[0]]:
            raise ValueError("this tokenizer does not keep words apart at white space")
        mixed = ["HELLO", "McDonald", "AbC1x", "It'S", "I'LL", *[chr(65 + i) + chr(97 + i) for i in range(26)]]
        self.folds_case = self._library(mixed) == self._library([w.lower() for w in mixed])
        marked = [(w, m) for w in ("word", "it's", "a1b", "U.S", "x", "9", "x7") for m in (*_MARKS.decode(), "...", '!"', "***&&&", "),")]
        self.parts_marks = self._library([w + m for w, m in marked]) == [a + b for a, b in zip(self._library([w for w, _ in marked]), self._library([m for _, m in marked]), strict=True)]
        self._words = _Words(self)

        # words of Latin letters are one piece in lower case, which the library's model can take at once, a character a byte
        latin = [c for c in map(chr, range(0x41, _LATIN_END)) if c.lower().isalpha()]
        plain = [f"{c}{d}" for c, d in zip(latin, latin[1:])] + [f"wor{c}d" for c in latin] + ["".join(latin[i % 26 :]) for i in range(26)]
        self._plain_is_piece = all(self._piece(w.lower()) == ids for w, ids in zip(plain, self._library(plain), strict=True))

    def _piece(self, text: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(text if text.isascii() else "".join(map(_BYTE_CHARACTERS.__getitem__, text.encode())))]

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_of(self, word: bytes) -> bytes:
        """Ids of one word by the library."""
        text = word.decode("utf-8", "replace")
        if self._plain_is_piece and text.isalpha() and max(text) < _LATIN_LAST and (low := text.lower()).isalpha():
            return array("I", self._piece(low)).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self._words) > MAX_WORDS:
            self._words.clear()
        get = self._words.__getitem__
        return [b"".join(map(get, text.split())) for text in texts]


class _Words(dict):
    """Ids of words met so far. ASCII words are looked up in lower case, and the marks behind a letter or digit apart."""

    def __init__(self, coder: WordIds):
        super().__init__()
        self.coder = coder

    def __missing__(self, word: bytes) -> bytes:
        if self.coder.has_control(word):
            ids = self.coder.ids_of(word)
        elif self.coder.parts_marks and word[-1] in _MARKS and (head := word.rstrip(_MARKS))[-1:].isalnum():
            ids = self[head] + self[word[len(head) :]]
        elif self.coder.folds_case and word.isascii() and not word.islower() and (low := word.lower()) != word:
            ids = self[low]
        else:
            ids = self.coder.ids_of(word)
        self[word] = ids
        return ids


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, shards: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id`` and write the shards in ascending document order.

    Documents are dealt by ranges of their id and sorted within; equal ids are ordered by text, so a repeated id makes
    equal ids follow each other, in a range of their own if they are many. A null text has the end id alone; null ids come
    first. An empty table leaves a table without rows.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"document ids must be integers, not {kind}")
    rows = docs.select(F.col(quoted(id_col)).cast("bigint").alias("doc_id"), text_bytes(text_col).alias("text"))
    dealt = rows.repartitionByRange(shards, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    schema = arrow_schema(spark, SHARD_SCHEMA)

    def shard_of(part: int, start: int, doc_ids: list, ids: list[bytes]) -> pa.RecordBatch:
        lengths = np.array([len(x) // 4 for x in ids], np.int64)
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        values = np.frombuffer(b"".join(ids), "<u4")
        data = Wavelet.build(values).pack(doc_ids, offsets)
        return pa.RecordBatch.from_pylist([{"part": part, "first_start": start, "n_docs": len(doc_ids), "n_tokens": len(values), "shard": data}], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, coder, end = TaskContext.get().partitionId(), word_ids(tokenizer_path), np.array([end_id], "<u4").tobytes()
        doc_ids, ids, held, start = [], [], 0, 0
        for batch in batches:
            for doc, coded in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1).to_pylist()), strict=True):
                doc_ids.append(doc)
                ids.append(coded + end)
                held += len(coded) // 4 + 1
                if held >= SHARD_TOKENS:
                    yield shard_of(part, start, doc_ids, ids)
                    start += held
                    doc_ids, ids, held = [], [], 0
        if doc_ids:
            yield shard_of(part, start, doc_ids, ids)

    dealt.mapInArrow(run, SHARD_SCHEMA).write.option("compression", "zstd").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The shards with ``start``, the number of ids in all parts before the shard's."""
    return spark.read.schema(SHARD_SCHEMA).parquet(folder)


def part_starts(shards: DataFrame) -> DataFrame:
    """Per part the number of ids before it; one row per task of the writing job."""
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("bigint").alias("part_start"))


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per document ``doc_id, start, n_tokens, ids_crc32``, unpacked from the written shards."""
    shards = read(spark, folder)
    schema = "part int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint"
    out = arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, data in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                wavelet, doc_ids, offsets = Wavelet.unpack(data)
                ids, cuts = memoryview(wavelet.all().astype("<u4").tobytes()), offsets.tolist()
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:])]
                starts = offsets.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(doc_ids), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(starts[:-1] + first), pa.array(np.diff(starts)), pa.array(crc, pa.int64())],
                    schema=out,
                )

    rows = shards.select("part", "first_start", "shard").mapInArrow(run, schema)
    return rows.join(part_starts(shards), "part").select("doc_id", (F.col("part_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
