"""Collocations by Toivonen's mining: a sample proposes phrases, one full pass counts them and their negative border exactly.

Texts are cut into pieces and words, A-Z lower-cased. In a sample of the documents all runs of up to five words are counted; those
that reach a lowered threshold are proposed. As part of a frequent phrase is frequent, the negative border are the phrases that are
not proposed though both their longest parts are, and all words that are not. The full pass counts what is proposed and the border:
each run of words whose two longest parts are proposed. If no phrase of the border is frequent, no longer one can be, and the counts
are complete. Frequent phrases of the border are failures; they open an expansion pass, which counts each run that was not counted
yet and all of whose parts are frequent or are themselves counted in this pass. That leaves no frequent run uncounted, so the border
is closed; the pass after it would have nothing to count and is left out.

Which phrases are proposed is known to the tasks by a blocked Bloom filter of bounded size. Where it says yes by mistake a phrase
more is counted, exactly, and dropped by the final threshold; so the filter's size changes no result. Runs are counted by 64-bit
hashes within a few megabytes of text and by the phrases themselves across tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import arrow_schema, quoted, text_bytes
from .shingles import mix, slice_hashes

SUPPORT, LONGEST, TOP = 100, 5, 2000
#: One document in ``SAMPLE``, drawn at random, is in the sample; there a phrase is proposed from this part of its expected count on, 2 at least.
SAMPLE, LOWERED = 20, 0.6
#: Bytes of text that a task takes up before it counts, and words that are counted at once.
STEP, WORDS = 3 << 20, 1 << 19
#: Shares of a language's phrases that are ranked apart before its first ones are.
SHARES = 64
#: 64-bit blocks of the largest filter (32 MB), and phrases that a block is made for.
MAX_BLOCKS, PER_BLOCK = 1 << 22, 4

#: A-Z to a-z, what parts pieces to a line feed, what parts words to a blank.
_PARTED = bytes.maketrans(bytes(range(0x41, 0x5B)) + b".,;:!?\x0b\x0c\x0d\x09", bytes(range(0x61, 0x7B)) + b"\n" * 9 + b" ")
_STEPS = np.uint64(0xD6E8FEB86659FD93)

Filter = tuple[np.ndarray, int]


def _cleaned(texts: list[bytes]) -> np.ndarray:
    """The texts' bytes, lower-cased, pieces parted by line feeds, words by one blank."""
    data = np.frombuffer(b"\n".join(texts).translate(_PARTED), np.uint8)
    blank = data == 0x20
    twice = np.zeros(len(data), bool)
    twice[1:] = blank[1:] & blank[:-1]
    return data[~twice] if twice.any() else data


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and whether each is followed by another of its piece."""
    gap = (data == 0x20) | (data == 0x0A)
    edge = np.diff(np.concatenate(([1], gap.view(np.int8), [1])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    lines = np.flatnonzero(data == 0x0A)
    piece = np.searchsorted(lines, starts)
    followed = np.zeros(len(starts), bool)
    followed[:-1] = piece[1:] == piece[:-1]
    return starts, ends, followed


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of the words; those of a stretch are taken at a time, so that memory does not follow the text."""
    out, first = [np.zeros(0, np.uint64)], 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + (1 << 20), side="right")))
        at = starts[first]
        out.append(slice_hashes(data[at : ends[last - 1]], starts[first:last] - at, ends[first:last] - at))
        first = last
    return mix(np.concatenate(out) ^ np.uint64(seed))


def _masks(hashes: np.ndarray) -> np.ndarray:
    """Four bits of 64 for each hash."""
    one, bits = np.uint64(1), mix(hashes ^ np.uint64(0xB10C))
    out = np.zeros(len(hashes), np.uint64)
    for k in range(4):
        out |= one << ((bits >> np.uint64(6 * k)) & np.uint64(63))
    return out


def _held(hashes: np.ndarray, proposed: Filter) -> np.ndarray:
    words, blocks = proposed
    mask = _masks(hashes)
    return (words[(hashes & np.uint64(blocks - 1)).astype(np.int64)] & mask) == mask


def _runs(words: np.ndarray, followed: np.ndarray, longest: int, filters: list[Filter]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length the hash of the run from each word on, and which are counted: all without a filter; with one those whose
    longest parts are proposed (all words); with two those that the first left out and whose parts are frequent by the second."""
    n = len(words)
    hashes, whole = words, np.ones(n, bool)
    before, fits = np.ones(n, bool), np.ones(n, bool)
    for length in range(1, longest + 1):
        if length > 1:
            m = len(hashes) - 1
            whole = whole[:m] & followed[length - 2 : length - 2 + m]
            hashes = mix(hashes[:m] * _STEPS + words[length - 1 : length - 1 + m])
            if filters:
                before = before[:m] & before[1 : m + 1] & whole
                fits = fits[:m] & fits[1 : m + 1] & whole
        if not filters:
            yield length, hashes, whole
            continue
        counted = before if length > 1 else whole
        yield length, hashes, counted if len(filters) == 1 else fits & ~counted if length > 1 else np.zeros(n, bool)
        here = np.zeros(len(hashes), bool)
        here[counted] = _held(hashes[counted], filters[0])
        if len(filters) == 2:
            known = np.zeros(len(hashes), bool)
            known[counted] = _held(hashes[counted], filters[1])
            fits = np.where(counted, known, fits)
        before = here


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The slices of ``data`` as an Arrow array."""
    sizes = ends - starts
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    picked = data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(picked.tobytes())])


def phrase_counts(rows: DataFrame, longest: int, filters: list[Filter]) -> DataFrame:
    """``lang, size, phrase, hash, n`` from ``lang, text``: counts of the runs that ``filters`` choose, a row per phrase; without filters or
    with one also the number of all words, as the empty phrase of size 0."""
    schema_text = "lang string, size int, phrase binary, hash bigint, n bigint"
    schema = arrow_schema(rows.sparkSession, schema_text)
    sent, totals = rows.sparkSession.sparkContext.broadcast(filters), len(filters) < 2

    def count(lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        data = _cleaned(texts)
        starts, ends, followed = _words(data)
        seed = int(slice_hashes(np.frombuffer(lang.encode() or b"\n", np.uint8), np.zeros(1, np.int64), np.array([len(lang.encode()) or 1]))[0])
        hashed = _hashes(data, starts, ends, seed)
        if totals:
            yield made(lang, 0, _gather(data, np.zeros(1, np.int64), np.zeros(1, np.int64)), np.zeros(1, np.uint64), np.array([len(starts)]))
        for first in range(0, len(starts), WORDS):
            # a run belongs to the stretch of words in which it starts; its parts reach a few words beyond
            part = slice(first, first + WORDS + longest - 1)
            for length, hashes, counted in _runs(hashed[part], followed[part], longest, sent.value):
                at = np.flatnonzero(counted[:WORDS])
                if len(at):
                    found, places, times = np.unique(hashes[at], return_index=True, return_counts=True)
                    places = at[places] + first
                    yield made(lang, length, _gather(data, starts[places], ends[places + length - 1]), found, times)

    def made(lang: str, size: int, phrases: pa.Array, hashes: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        n = len(times)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang]).take(pa.array(np.zeros(n, np.int32))), pa.array(np.full(n, size, np.int32)), phrases, pa.array(hashes.view(np.int64)), pa.array(times.astype(np.int64))],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size >= STEP:
                    for one, texts in held.items():
                        yield from count(one, texts)
                    held, size = {}, 0
        for one, texts in held.items():
            yield from count(one, texts)

    counted = rows.mapInArrow(run, schema_text)
    return counted.groupBy("lang", "size", "phrase").agg(F.max("hash").alias("hash"), F.sum("n").alias("n"))


def _filter(phrases: DataFrame, most: int) -> Filter:
    """The blocked Bloom filter of the phrases' hashes: ``most`` blocks at most come to the driver and go to the tasks."""
    n = phrases.count()
    blocks = min(most, 1 << max(0, (n - 1) // PER_BLOCK).bit_length())
    schema_text = "block bigint, bits bigint"
    schema = arrow_schema(phrases.sparkSession, schema_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            block = (hashes & np.uint64(blocks - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(_masks(hashes).view(np.int64))], schema=schema)

    table = phrases.select("hash").mapInArrow(run, schema_text).groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(blocks, np.uint64)
    words[table.column("block").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return words, blocks


def frequent_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT, longest: int = LONGEST, sample: int = SAMPLE, lowered: float = LOWERED, blocks: int = MAX_BLOCKS
) -> DataFrame:
    """``lang, size, phrase, n`` of every run of up to ``longest`` words found ``support`` times or more in its language, and the number
    of all words of a language as the empty phrase of size 0. Null languages count as ``und``, null texts as empty."""
    lang = F.coalesce(F.col(quoted(lang_col)).cast("string"), F.lit("und"))
    rows = docs.select(lang.alias("lang"), text_bytes(text_col).alias("text"))
    # whatever the draw is, the filter made of it is fixed before the full pass, and the result does not depend on it
    chosen = rows.where(F.rand(20240501) * sample < 1)
    low = max(2, int(support / sample * lowered))
    proposed = materialise(phrase_counts(chosen, longest, []).where(F.col("n") >= low).where("size > 0").select("hash"))
    first = _filter(proposed, blocks)
    found = materialise(phrase_counts(rows, longest, [first]).where((F.col("n") >= support) | (F.col("size") == 0)))
    failed = found.where("size > 0").join(proposed.distinct(), "hash", "left_anti").limit(1).count()
    if failed:
        second = _filter(found.where("size > 0"), blocks)
        more = phrase_counts(rows, longest, [first, second]).where(F.col("n") >= support)
        found = found.unionByName(materialise(more))
    return found.select("lang", "size", F.col("phrase").cast("string").alias("phrase"), "n")


def mine(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, sample: int = SAMPLE, lowered: float = LOWERED, blocks: int = MAX_BLOCKS
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language.

    ``a, l, r`` count the phrase, its first part and its rest at the cut of lowest score ``floor(1000 a n / (l r))``, ``n`` all words.
    A phrase that stands in a longer frequent one as often as alone is left out: if it does in any, it does in one that is a word longer.
    Ties of score and count go to the phrase first in UTF-8 order.

    Null texts are empty, null languages ``und``; a repeated row counts as often as it stands; an empty table, or one whose phrases
    are all rare, gives an empty result. Only the two columns named are read, so other columns may have any name. Texts of any length
    are counted in stretches. A phrase of a third of all rows is added up within tasks before the shuffle.
    """
    found = materialise(frequent_phrases(docs, text_col, lang_col, support, longest, sample, lowered, blocks))
    words = F.split("phrase", " ", -1)
    long = found.where("size > 1").withColumn("words", words)

    def part(at: Column, size: Column) -> Column:
        return F.array_join(F.slice("words", at, size), " ")

    inside = long.where("size > 2").select("lang", "n", F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1))).alias("phrase"))
    own = long.join(inside.distinct(), ["lang", "phrase", "n"], "left_anti")
    cuts = own.select("lang", "phrase", F.col("n").alias("a"), "size", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest")
    )
    known = found.where("size > 0")
    left = known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    totals = found.where("size = 0").select("lang", F.col("n").alias("total"))
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    scored = (
        cuts.join(left, ["lang", "first"])
        .join(right, ["lang", "rest"])
        .join(totals, "lang")
        .withColumn("score", exact_score(whole("a"), whole("total"), whole("l"), whole("r")))
    )
    best = scored.groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    flat = best.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each share of a language hold the first of the language, so its last task meets few rows
    shares = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).orderBy(*by)
    firsts = flat.withColumn("rank", F.row_number().over(shares)).where(F.col("rank") <= top).drop("rank")
    ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def exact_score(a: Column, n: Column, l: Column, r: Column) -> Column:
    """``floor(1000 a n / (l r))``. With ``1000 n = x l + y`` it is ``(a x + floor(a y / l)) div r``, as a floor of a floor keeps its
    value; ``a <= l`` and ``a <= r`` keep every product within 38 digits for counts of up to 18."""
    thousand = (n * F.lit(1000)).cast("decimal(22,0)")
    x = F.call_function("div", thousand, l).cast("decimal(19,0)")
    y = (thousand - x.cast("decimal(22,0)") * l).cast("decimal(19,0)")
    inner = (a * x).cast("decimal(38,0)") + F.call_function("div", a * y, l).cast("decimal(19,0)")
    return F.call_function("div", inner.cast("decimal(38,0)"), r)


#: The same over ``documents`` in DuckDB's SQL.
ORACLE = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM piece),
runs AS (SELECT lang, words, k, unnest(generate_series(1, len(words) - k + 1)) AS i FROM w, generate_series(1, 5) AS s(k) WHERE len(words) >= k),
f AS (SELECT lang, k AS size, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM runs GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY ALL),
candidate AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE size > 1 AND f >= 100),
inside AS (
  SELECT DISTINCT lang, array_to_string(words[i:j], ' ') AS phrase, a
  FROM candidate, generate_series(1, 5) AS x(i), generate_series(1, 5) AS y(j) WHERE i < j AND j <= size AND j - i + 1 < size
), cut AS (
  SELECT c.lang, c.phrase, c.a, k, array_to_string(words[1:k], ' ') AS first, array_to_string(words[k + 1:], ' ') AS rest
  FROM candidate c, generate_series(1, 4) AS s(k)
  WHERE k < size AND NOT EXISTS (FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND i.a >= c.a)
), scored AS (
  SELECT cut.*, l.f AS l, r.f AS r, total.n, (1000::HUGEINT * cut.a * total.n) // (l.f::HUGEINT * r.f) AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = first JOIN f r ON r.lang = cut.lang AND r.phrase = rest JOIN total ON total.lang = cut.lang
), best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
