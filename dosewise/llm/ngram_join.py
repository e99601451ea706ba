"""N-gram Jaccard join by vertical partitioning, and its components.

A document is the set of its word shingles' hashes. One global order sorts all shingles: those that few documents have
first, frequent ones last. Two sets of similarity t share a shingle among the first ``n - ceil(t n) + 1`` of either, so only
documents that share such a prefix shingle are compared, and of those only pairs whose sizes allow the similarity and whose
parity sketches (a bit flipped per shingle: differing bits never outnumber differing shingles) do not rule it out.

The overlap of a pair is counted by vertical partitioning: the order is cut into fragments by the leading bits of the hash,
every set into a segment per fragment, the partial overlaps are counted fragment by fragment and summed per pair. The first
fragment alone rules out most pairs, as its difference already exceeds what the whole pair may differ by; it is kept beside the
prefixes for that, so that few texts have to be read again.

Only components are wanted, so not all links are listed: equal sets are one node; each prefix list is first compared with one
of its members alone, and after the components of these links only pairs of different components are compared. A skipped
pair lies in one component already, so the components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import ASCII_LOWER, arrow_schema, components, map_rows, quoted, text_bytes
from .shingles import mix, shingle_set, word_hashes

SHINGLE = 3
#: Similarity in percent.
PERCENT = 90
FRAGMENTS = 8
#: Sizes of sets up to which a sketch of 256 bits can tell differences, and of larger ones with the longs of their wider sketches.
SKETCHED = 600
WIDER = {2400: 16, 9600: 64}
#: Shingles counted at once in a task, and the sum from which a shingle counts as frequent.
COUNT_STEP, FREQUENT = 4_000_000, 8
#: Entries of the table of frequent shingles that is sent to all tasks (16 bytes each), at most: the most frequent ones. It only
#: orders shingles, so its bound has no influence on the result.
FREQUENT_ENTRIES = 1 << 20


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(quoted(id_col)).cast("bigint").alias("doc"), text_bytes(text_col).alias("text"))


def _set(text: bytes, width: int) -> np.ndarray:
    return shingle_set(word_hashes(text.translate(ASCII_LOWER)), width)


def _digest(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two signed numbers."""
    s1 = mix(own + np.uint64(1)).sum(dtype=np.uint64)
    s2 = np.bitwise_xor.reduce(mix(own ^ np.uint64(0xA5A5A5A5)), initial=np.uint64(0))
    return tuple(_signed(np.array([s1, s2], np.uint64)).tolist())


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def sets(rows: DataFrame, width: int) -> DataFrame:
    """Two kinds of rows of one pass: ``doc, n, s1, s2`` (size and 128-bit digest of a document's set), and ``s1, n`` with
    ``kind`` 1: shingles found three times or more among a few million neighbours in the input, and how often."""
    schema_text = "kind int, doc bigint, n bigint, s1 bigint, s2 bigint"
    schema = arrow_schema(rows.sparkSession, schema_text)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate(held), return_counts=True)
        found, counts = found[counts > 2], counts[counts > 2]
        none = pa.nulls(len(found), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(found), np.int32)), none, pa.array(counts), pa.array(_signed(found)), none], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = _set(text, width)
                out.append((0, doc, len(own), *_digest(own)))
                held.append(own)
                size += len(own)
                if size >= COUNT_STEP:
                    yield counted(held)
                    held, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if held:
            yield counted(held)

    return rows.mapInArrow(run, schema_text)


def prefixes(rows: DataFrame, frequent: tuple[np.ndarray, np.ndarray], width: int, percent: int, fragments: int) -> DataFrame:
    """Per row ``doc, n, s1, s2``, its sketch (four longs), the first fragment's shingles cut to 32 bits, and the prefix of its set
    in the global order. A sketch says nothing of a large set and is left 0 there; such a set has a wider one in ``wide``, if it is
    not larger than ``WIDER`` tells. Only sketches of one width are compared. Cut shingles may agree by chance, which can
    only make a difference look smaller, so they rule out no link."""
    table = rows.sparkSession.sparkContext.broadcast(frequent)

    def make():
        hot, counts = table.value

        def row(doc, text):
            own = _set(text, width)
            n = len(own)
            size = n - (percent * n + 99) // 100 + 1 if n else 0
            if n and len(hot):
                place = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
                often = np.where(hot[place] == own, counts[place], 0)
            else:
                often = np.zeros(n, np.int64)
            # own is ascending, so a stable sort by count orders by count and then by hash
            prefix = own[np.argsort(often, kind="stable")[:size]]
            some = own if n <= SKETCHED else own[:0]
            bits = np.bincount((some & np.uint64(255)).astype(np.int64), minlength=256) & 1
            sketch = _signed(np.packbits(bits.astype(np.uint8)).view(np.uint64)).tolist()
            longs = next((size for most, size in WIDER.items() if SKETCHED < n <= most), 0)
            flips = np.bincount((own & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1 if longs else np.zeros(0, np.int64)
            wide = _signed(np.packbits(flips.astype(np.uint8)).view(np.uint64)).tolist()
            part = own[: np.searchsorted(own, np.uint64((1 << 64) // fragments))]
            return doc, n, *_digest(own), *sketch, wide, (part & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32).tolist(), _signed(prefix).tolist()

        return row

    return map_rows(rows, "doc bigint, n bigint, s1 bigint, s2 bigint, k1 bigint, k2 bigint, k3 bigint, k4 bigint, wide array<bigint>, part array<int>, prefix array<bigint>", make)


def segments(rows: DataFrame, width: int, fragments: int) -> DataFrame:
    """``doc, n, s1, s2, fragment, segment``: each row's set cut by the leading bits of its hashes."""
    schema_text = "doc bigint, n bigint, s1 bigint, s2 bigint, fragment int, segment array<bigint>"
    schema = arrow_schema(rows.sparkSession, schema_text)
    cuts = np.array([(k << 64) // fragments for k in range(1, fragments)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            traits, numbers, values, ends = [], [], [], [0]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = _set(text, width)
                digest = _digest(own)
                for k, part in enumerate(np.split(own, np.searchsorted(own, cuts))):
                    traits.append((doc, len(own), *digest))
                    numbers.append(k)
                    values.append(_signed(part))
                    ends.append(ends[-1] + len(part))
            if traits:
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values)))
                columns = [pa.array(v, pa.int64()) for v in zip(*traits, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(numbers, pa.int32()), lists.cast(schema.field(5).type)], schema=schema)

    return rows.mapInArrow(run, schema_text)


def _possible(percent: int) -> str:
    """Sizes and sketches of ``x`` and ``y`` allow the similarity. A difference d and sizes m, n: overlap (m + n - d) / 2,
    union (m + n + d) / 2, so d (100 + p) <= (m + n) (100 - p). Sketches count where both sets have one of the same width."""
    bits = " + ".join(f"bit_count(x.k{i} ^ y.k{i})" for i in range(1, 5))
    wide = "aggregate(zip_with(x.wide, y.wide, (a, b) -> bit_count(a ^ b)), 0, (s, v) -> s + v)"
    fits = f"* {100 + percent} <= (x.n + y.n) * {100 - percent}"
    small = f"greatest(x.n, y.n) <= {SKETCHED} AND ({bits}) {fits}"
    large = f"greatest(x.n, y.n) > {SKETCHED} AND (size(x.wide) <> size(y.wide) OR size(x.wide) = 0 OR {wide} {fits})"
    return f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) AND (({small}) OR ({large}))"


def numbered(nodes: DataFrame) -> DataFrame:
    """``nodes`` (distinct sets ``n, s1, s2`` and their lowest document) with a number ``key`` of each set's own: a hash of the
    three, with the first seed that gives no two sets the same."""
    count = nodes.count()
    for seed in range(64):
        keyed = materialise(nodes.withColumn("key", F.xxhash64(F.lit(seed), "n", "s1", "s2")))
        if keyed.select("key").distinct().count() == count:
            return keyed
    raise RuntimeError("no seed numbers all sets apart")


def of_nodes(found: DataFrame, nodes: DataFrame, within: list[str]) -> DataFrame:
    """The rows of ``found`` that describe a node (its document's own set), once each per ``within``, with its ``key``."""
    own = ["doc", "n", "s1", "s2"]
    return found.join(nodes.select(F.col("node").alias("doc"), "n", "s1", "s2", "key"), own).dropDuplicates([*own, *within]).drop("s1", "s2")


def possible_by_part(pairs: DataFrame, described: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs ``a, b`` that the first fragment's difference alone does not rule out."""
    x = described.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("part").alias("pa"))
    y = described.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("part").alias("pb"))
    difference = F.size("pa") + F.size("pb") - 2 * F.size(F.array_intersect("pa", "pb"))
    both = pairs.distinct().join(x, "a").join(y, "b")
    return both.where(difference * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)).select("a", "b").distinct()


def verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, width: int, percent: int, fragments: int) -> DataFrame:
    """The pairs ``a, b`` of nodes that are links: partial overlaps are counted fragment by fragment and summed per pair. A node
    has its segments once, however many rows repeat it."""
    pairs = materialise(pairs)
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    wanted = materialise(nodes.join(keys, "key", "left_semi"))
    cut = segments(rows.join(wanted.select(F.col("node").alias("doc")).distinct(), "doc", "left_semi"), width, fragments)
    cut = materialise(of_nodes(cut, wanted, ["fragment"]))
    x = cut.select(F.col("key").alias("a"), "fragment", F.col("n").alias("na"), F.col("segment").alias("sa"))
    y = cut.select(F.col("key").alias("b"), "fragment", F.col("n").alias("nb"), F.col("segment").alias("sb"))
    partial = pairs.join(x, "a").join(y, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("common"))
    sums = partial.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    return materialise(sums.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b").distinct())


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT, fragments: int = FRAGMENTS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs``; the component's id is its smallest document id.

    Documents link when their sets' similarity is ``percent`` or more. A null or empty text has an empty set and links with
    nothing; rows that repeat an id and a set give a row each and count once; an id with several texts has a set, and so a
    component, for each of them; a row with a null id takes the component of its set, null if no
    id is in it; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = _rows(docs, id_col, text_col)
    found = materialise(sets(rows, width))
    own = found.where("kind = 0").select("doc", "n", "s1", "s2")
    nodes = numbered(materialise(own.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc").alias("node")).where("node is not null")))
    counts = found.where("kind = 1").groupBy(F.col("s1").alias("shingle")).agg(F.sum("n").alias("times")).where(F.col("times") >= FREQUENT)
    counts = materialise(counts)
    # the lowest level of frequency from which the entries fit the table; levels are few, so their sizes are all that is read first
    level = F.floor(4 * F.log2("times"))
    sizes = sorted(((r["level"], r["size"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("size")).collect()), reverse=True)
    fitting = [at for at, total in zip((x for x, _ in sizes), np.cumsum([n for _, n in sizes]).tolist()) if total <= FREQUENT_ENTRIES]
    top = counts.where(level >= (min(fitting) if fitting else 1 << 20)).toPandas()
    hot = top["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hot)
    frequent = (hot[order], top["times"].to_numpy(np.int64)[order])

    # copies leave here: a node is described once, by its lowest document
    described = materialise(of_nodes(prefixes(rows, frequent, width, percent, fragments), nodes, []))
    traits = described.drop("prefix", "part", "doc")
    by_shingle, by_size = Window.partitionBy("shingle"), Window.partitionBy("shingle").orderBy("n")
    posts = described.select("doc", "key", "n", F.explode("prefix").alias("shingle"))
    shared = (
        posts.withColumn("below", F.lag("n").over(by_size))
        .withColumn("above", F.lead("n").over(by_size))
        .withColumn("leader", F.min(F.struct("doc", "key")).over(by_shingle)["key"])
        .withColumn("size", F.count("*").over(by_shingle))
        # in a list ordered by size, a set that fits neither neighbour's size fits none
        .where(f"size > 1 AND (100 * below >= {percent} * n OR 100 * n >= {percent} * above)")
        .select("key", "shingle", "leader")
    )
    members = materialise(shared)

    star = (
        members.where("key <> leader")
        .select("leader", "key")
        .distinct()
        .join(traits, "key")
        .alias("x")
        .join(traits.alias("y"), F.expr(f"x.leader = y.key AND {_possible(percent)}"))
        .select(F.col("x.leader").alias("a"), F.col("x.key").alias("b"))
    )
    links = verified(possible_by_part(star, described, percent), rows, nodes, width, percent, fragments)
    labels = components(links)
    named = members.select("key", "shingle").join(labels.withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    # lists whose members are in one component already are settled, and no sketch is sent for them
    unsettled = named.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("shingle")
    labelled = materialise(named.join(unsettled, "shingle", "left_semi").join(traits, "key"))
    cross = (
        labelled.alias("x")
        .join(labelled.alias("y"), F.expr(f"x.shingle = y.shingle AND x.key < y.key AND x.component <> y.component AND {_possible(percent)}"))
        .select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
        .distinct()
    )
    more = verified(possible_by_part(cross, described, percent), rows, nodes, width, percent, fragments)
    final = materialise(nodes.join(components(links.union(more)).withColumnRenamed("id", "key"), "key"))
    lowest = final.groupBy("component").agg(F.min("node").alias("lowest"))
    by_set = nodes.join(final.join(lowest, "component").select("key", "lowest"), "key", "left").select("n", "s1", "s2", F.coalesce("lowest", "node").alias("component"))
    out = own.join(by_set, ["n", "s1", "s2"], "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))
