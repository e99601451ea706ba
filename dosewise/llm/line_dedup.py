"""Line dedup by overlapping three-line windows, with DataFrame functions only.

Every three consecutive lines of a text (cut at line feeds, taken as they are) are a window, unless all three are blank.
Of equal windows anywhere in the table the first occurrence stays - lowest document key, then lowest position - and the
lines of every later one are removed; ranges that overlap merge by being removed once. Every removed line's window has a
first occurrence, and first occurrences of a lower key lose lines only to windows that occur still earlier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, quoted

WINDOW = 3
#: Fixed seed that makes the second half of a window's 128-bit hash independent of the first.
_SECOND = 0x5EED


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _windows(lines: Column, window: int) -> Column:
    """Structs ``(at, h1, h2)`` of the windows with a line that is not blank."""
    starts = F.when(F.size(lines) >= window, F.sequence(F.lit(0), F.size(lines) - window)).otherwise(F.array().cast("array<int>"))

    def one(at: Column) -> Column:
        parts = [F.element_at(lines, at + 1 + n) for n in range(window)]
        filled = F.length(F.trim(F.concat(*parts))) > 0
        return F.when(filled, F.struct(at.alias("at"), F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(_SECOND), *reversed(parts)).alias("h2")))

    return F.filter(F.transform(starts, one), lambda w: w.isNotNull())


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with all its columns, the text without repeated windows, and ``n_lines`` and ``n_removed`` added.

    A document is known by its id and text: rows that repeat both are one document and come out alike, with no line of
    theirs removed for the other's sake; the same text under two ids is a copy, and all its windows go from the later id.
    Null ids come first in the order; a null text stays null; texts of fewer lines than a window are never changed; an empty
    table stays empty. If the table has columns of the added names, ``_1`` is appended.

    Occurrences are counted by partial sums before the shuffle, so a window that a third of all rows hold is no burden to
    one task; the join that finds later occurrences has the one row of the first on its other side, and Spark splits it.
    """
    taken = list(docs.columns)
    n_lines, n_removed = free_name(taken, "n_lines"), free_name(taken, "n_removed")
    doc, text = F.col(quoted(id_col)), F.col(quoted(text_col))
    keyed = docs.select(doc.alias("doc"), F.xxhash64(text).alias("copy"), _lines(text).alias("lines"))
    windows = keyed.select("doc", "copy", F.explode(_windows(F.col("lines"), window)).alias("w")).select(
        "w.h1", "w.h2", F.struct("doc", "copy", "w.at").alias("place")
    )
    first = windows.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last")
    later = windows.join(first.select("h1", "h2", "first"), ["h1", "h2"]).where(~F.col("place").eqNullSafe(F.col("first")))
    starts = later.groupBy(F.col("place.doc").alias("doc"), F.col("place.copy").alias("copy")).agg(F.collect_set("place.at").alias("starts"))
    covered = starts.select(
        "doc", "copy", F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda at: F.sequence(at, at + (window - 1)))))).alias("gone")
    )
    # one byte per line up to the last removed one, so that a line's look-up costs the same in a text of any length
    before = lambda n: F.when(n == 0, F.lit(-1)).otherwise(F.get(F.col("gone"), n - 1))
    flags = F.transform("gone", lambda at, n: F.concat(F.repeat(F.lit("0"), at - before(n) - 1), F.lit("1")))
    gone = covered.select("doc", "copy", F.size("gone").alias("n_gone"), F.array_join(flags, "").cast("binary").alias("gone"))
    mark, mark_doc, mark_copy, mark_n = (free_name(taken, n) for n in ("gone", "gone_doc", "gone_copy", "gone_n"))
    gone = gone.select(F.col("doc").alias(mark_doc), F.col("copy").alias(mark_copy), F.col("n_gone").alias(mark_n), F.col("gone").alias(mark))
    joined = docs.join(gone.hint("shuffle_hash"), doc.eqNullSafe(F.col(quoted(mark_doc))) & (F.xxhash64(text) == F.col(quoted(mark_copy))), "left")
    lines, hit = _lines(text), F.col(quoted(mark))
    kept = F.filter(lines, lambda line, at: F.substring(hit, at + 1, F.lit(1)) != F.lit(b"1"))
    new_text = F.when(hit.isNull(), text).otherwise(F.array_join(kept, "\n"))
    columns = [new_text.alias(c) if c == text_col else F.col(quoted(c)) for c in taken]
    return joined.select(
        *columns,
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("bigint").alias(n_lines),
        F.coalesce(F.col(quoted(mark_n)), F.lit(0)).cast("bigint").alias(n_removed),
    )


#: The same over ``documents`` in DuckDB's SQL, on the lines themselves instead of hashes.
ORACLE = """
WITH doc AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
win AS (
  SELECT doc_id, p AS pos, lines[p] || chr(10) || lines[p + 1] || chr(10) || lines[p + 2] AS w
  FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines) - 2)) AS p FROM doc WHERE len(lines) >= 3)
  WHERE length(trim(lines[p] || lines[p + 1] || lines[p + 2], ' ')) > 0
),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS nth FROM win),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM ranked, (VALUES (0), (1), (2)) AS v(k) WHERE nth > 1),
line AS (SELECT doc_id, unnest(lines) AS line, unnest(generate_series(1, len(lines))) AS pos FROM doc)
SELECT doc.doc_id, doc.lang, doc.source, doc.n_lines, doc.n_lines - coalesce(k.n_kept, 0) AS n_removed,
  coalesce(k.text, '') AS text
FROM (SELECT d.doc_id, d.lang, d.source, len(doc.lines) AS n_lines FROM documents d JOIN doc USING (doc_id)) AS doc
LEFT JOIN (
  SELECT line.doc_id, count(*) AS n_kept, string_agg(line.line, chr(10) ORDER BY line.pos) AS text
  FROM line LEFT JOIN gone USING (doc_id, pos) WHERE gone.pos IS NULL GROUP BY line.doc_id
) AS k USING (doc_id)
"""
