"""Source divergence audit: how far the sources of a language are from each other, and which terms set a source apart.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. A language keeps the terms that ``MIN_DOCS`` of its
documents hold. A source's share of a term is ``p = 1 + floor(SCALE (count + 5) / (N + 5 V))``, N its count of kept terms and V their
number; terms that a source lacks all have the same share ``p0``. Two sources differ by the sum of |p - q| over all kept terms.

That sum is not taken over all terms of all pairs. It is ``V |p0 - q0|``, corrected for each source's terms as if the other lacked
them (by the few distinct shares of a source), corrected again where both have the term. The last corrections come from a
frequent-pattern tree: a term's row is the list of the sources that hold it with their shares, in the order of the sources; equal
rows are one with a multiplicity, and rows with equal beginnings share a path. A node's correction with each of its ancestors is
added once, times the number of terms below the node. Rows are dealt out by ranges and sorted, so a task meets the tree's nodes in
depth-first order and holds one path of it; a node that two tasks share is counted in parts, which changes no sum.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import arrow_schema, quoted, text_bytes

MIN_DOCS, SMOOTHING, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Counts, or sums of pairs, that a task holds before it passes them on; bytes of a text that are cut into terms at once.
HELD, STEP = 400_000, 1 << 20

#: A-Z to a-z, and all that ends a term to a blank.
_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b > 0x7F else 0x20 for b in range(256))


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text with blanks for all that ends a term, in pieces cut at blanks."""
    text = text.translate(_TERMS)
    at = 0
    while len(text) - at > STEP:
        cut = text.find(b" ", at + STEP)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term by group; a null term with 0 for each group."""
    schema_text = "lang string, source string, term binary, n bigint, docs bigint"
    schema = arrow_schema(docs.sparkSession, schema_text)

    def batch_of(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
        langs, sources, terms, n, d = [], [], [], [], []
        for (lang, source), (total, having) in held.items():
            langs += [lang] * (len(total) + 1)
            sources += [source] * (len(total) + 1)
            terms += [None, *total]
            n += [0, *total.values()]
            d += [0, *(having[t] for t in total)]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((langs, sources, terms, n, d), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                group = held.setdefault((lang, source), (Counter(), Counter()))
                own: set[bytes] = set()
                for piece in _pieces(text):
                    words = piece.split()
                    group[0].update(words)
                    own.update(words)
                group[1].update(own)
            if sum(len(g[0]) + 1 for g in held.values()) >= HELD:
                yield batch_of(held)
                held = {}
        if held:
            yield batch_of(held)

    rows = docs.select(*(F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))), text_bytes(text_col).alias("text"))
    counted = rows.mapInArrow(run, schema_text)
    return counted.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column, smoothing: int = SMOOTHING, scale: int = SCALE) -> Column:
    """The smoothed share in whole numbers, exact; null where no term is kept."""
    parts = F.lit(scale).cast("decimal(12,0)") * (count + F.lit(smoothing)).cast("decimal(20,0)")
    whole = total.cast("bigint") + F.lit(smoothing).cast("bigint") * terms.cast("bigint")
    return F.when(terms > 0, F.call_function("div", parts, whole.cast("decimal(20,0)")) + 1)


def tree_corrections(rows: DataFrame) -> DataFrame:
    """``lang, a, b, value``: from ``lang, path, m`` (items ``source, p, p0`` in the order of sources, and how many terms have the
    path) the partial sums over terms that sources ``a < b`` both hold of |p - q| + |p0 - q0| - |p - q0| - |q - p0|."""
    schema_text = "lang string, a string, b string, value bigint"
    schema = arrow_schema(rows.sparkSession, schema_text)

    class Tree:
        """The open path of one language's tree, and the sums of the nodes closed so far by pair of sources."""

        def __init__(self, lang: str):
            self.lang, self.path = lang, []
            self.ids: dict[str, int] = {}
            self.at, self.p, self.p0, self.m = (np.zeros(16, np.int64) for _ in range(4))
            self.pairs, self.values, self.size = [], [], 0

        def close(self, depth: int) -> None:
            """Close the nodes deeper than ``depth``, all at once: a node counts the terms of those below it too."""
            d = len(self.path)
            if d <= depth:
                return
            self.m[depth:d] = self.m[depth:d][::-1].cumsum()[::-1]
            if depth:
                self.m[depth - 1] += self.m[depth]
            depths = np.arange(depth, d)
            node = np.repeat(depths, depths)
            ancestor = np.arange(len(node)) - np.repeat(depths.cumsum() - depths, depths)
            p, p0, q, q0 = self.p[ancestor], self.p0[ancestor], self.p[node], self.p0[node]
            self.values.append(self.m[node] * (np.abs(p - q) + np.abs(p0 - q0) - np.abs(p - q0) - np.abs(p0 - q)))
            self.pairs.append(self.at[ancestor] << 32 | self.at[node])
            self.size += len(node)
            del self.path[depth:]

        def insert(self, path: list[tuple[str, int, int]], m: int) -> None:
            common = 0
            while common < min(len(path), len(self.path)) and path[common] == self.path[common]:
                common += 1
            self.close(common)
            if len(path) > len(self.at):
                self.at, self.p, self.p0, self.m = (np.concatenate([v, np.zeros(2 * len(path) - len(v), np.int64)]) for v in (self.at, self.p, self.p0, self.m))
            for d in range(common, len(path)):
                source, self.p[d], self.p0[d] = path[d]
                self.at[d] = self.ids.setdefault(source, len(self.ids))
                self.m[d] = 0
            self.path = path
            if path:
                self.m[len(path) - 1] += m

        def reduce(self) -> None:
            """One sum for each pair."""
            if self.size:
                pairs, values = np.concatenate(self.pairs), np.concatenate(self.values)
                order = np.argsort(pairs, kind="stable")
                first = np.flatnonzero(np.diff(pairs[order], prepend=-1))
                self.pairs, self.values, self.size = [pairs[order][first]], [np.add.reduceat(values[order], first)], len(first)

        def flush(self) -> Iterator[pa.RecordBatch]:
            self.reduce()
            if self.size:
                names, pairs = pa.array(list(self.ids), pa.string()), self.pairs[0]
                a, b = (names.take(pa.array(v)) for v in (pairs >> 32, pairs & 0xFFFFFFFF))
                yield pa.RecordBatch.from_arrays([pa.array([self.lang] * len(pairs), pa.string()), a, b, pa.array(self.values[0])], schema=schema)
            self.pairs, self.values, self.size = [], [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            for lang, path, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tree is None or lang != tree.lang:
                    if tree is not None:
                        tree.close(0)
                        yield from tree.flush()
                    tree = Tree(lang)
                elif tree.size > 4 * HELD:
                    tree.reduce()
                    if tree.size > HELD:
                        yield from tree.flush()
                tree.insert([(i["source"], i["p"], i["p0"]) for i in path], m)
        if tree is not None:
            tree.close(0)
            yield from tree.flush()

    # ranges of hashed beginnings keep like beginnings together, and what Spark samples to set the ranges stays short
    beginnings = [F.xxhash64(F.slice("path", 1, n)) for n in (1, 2, 4, 8)]
    dealt = rows.repartitionByRange("lang", *beginnings, F.xxhash64("path")).sortWithinPartitions("lang", "path")
    return dealt.select("lang", "path", "m").mapInArrow(run, schema_text)


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (language, source) of ``docs``.

    Part ``pair``: every other source of the language and how far it is, all ranks; part ``term``: the kept terms of which the source
    has a larger share than its language, and by how much, the first ``top``. Ties go to the item first in UTF-8 order.

    Null texts, languages and sources count as empty; a source without terms is compared like any other; where no term is kept all
    distances are 0; a repeated row counts as often as it stands; an empty table gives an empty result. Only the three columns named
    are read, so other columns may have any name. Counts of a term that all rows hold are added up within tasks before the shuffle.
    """
    counts = materialise(term_counts(docs, text_col, lang_col, source_col))
    groups = counts.select("lang", "source").distinct()
    by_term = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("in_lang")).where(F.col("docs") >= min_docs)
    kept = by_term.select("lang", "term", "in_lang")
    held = materialise(counts.where("term IS NOT NULL").select("lang", "source", "term", "n").join(kept, ["lang", "term"]))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("in_lang").alias("lang_total"))
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    traits = materialise(
        groups.join(totals, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .select("lang", "source", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("total", "terms", "lang_total")))
        .withColumn("p0", share(F.lit(0), F.col("total"), F.col("terms")))
    )
    cells = materialise(
        held.join(traits, ["lang", "source"])
        .withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
        .withColumn("q", share(F.col("in_lang"), F.col("lang_total"), F.col("terms")))
        .select("lang", "source", "term", "p", "p0", "q")
    )
    rows = cells.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "p", "p0"))).alias("path"))
    both = tree_corrections(materialise(rows.groupBy("lang", "path").agg(F.count("*").alias("m"))))

    x = traits.select("lang", F.col("source").alias("a"), F.col("p0").alias("p0a"), "terms")
    y = traits.select("lang", F.col("source").alias("b"), F.col("p0").alias("p0b"))
    base = x.join(y, "lang").where("a <> b").select("lang", "a", "b", F.coalesce(F.col("terms") * F.abs(F.col("p0a") - F.col("p0b")), F.lit(0)).alias("value"))
    shares = cells.groupBy("lang", F.col("source").alias("a"), "p", F.col("p0").alias("p0a")).agg(F.count("*").alias("m"))
    alone = F.col("m") * (F.abs(F.col("p") - F.col("p0b")) - F.abs(F.col("p0a") - F.col("p0b")))
    single = shares.join(y, "lang").where("a <> b").groupBy("lang", "a", "b").agg(F.sum(alone).alias("value"))
    swapped = lambda df: df.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    parts = base.union(single).union(swapped(single)).union(both).union(swapped(both))
    pairs = parts.groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("value").alias("value"))
    terms = cells.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").union(ranked(terms, "term").where(F.col("rank") <= top))


#: The same over ``documents`` in DuckDB's SQL, from all kept terms of all pairs.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS nr, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), w AS (SELECT nr, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
k AS (SELECT lang, term, count(*) AS in_lang FROM w GROUP BY ALL HAVING count(DISTINCT nr) >= 30),
v AS (SELECT lang, count(*) AS v, sum(in_lang) AS total FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
dense AS (
  SELECT g.lang, g.source, k.term, k.in_lang, coalesce(c.n, 0) AS n, v.v, v.total AS lang_total,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
), p AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (in_lang + 5)) // (lang_total + 5 * v)::HUGEINT AS q
  FROM dense
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL
  ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), every AS (
  SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""
