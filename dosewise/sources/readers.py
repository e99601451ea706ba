"""Table, matrix, list and record readers."""

from __future__ import annotations

import csv
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dosewise.constants import EMPTY_ENTITY
from dosewise.functions.numbers import to_number
from dosewise.functions.text import decode_missing, strip_blank
from dosewise.session import arrow_schema, materialise

#: Characters of records that a task holds before it passes them on.
_RECORD_BYTES = 16 << 20
_SEPARATORS = {".csv": ",", ".tsv": "\t"}
#: Default of the widest text table that ``read_table`` takes; a parameter there.
MAX_COLUMNS = 65536


def read_table(
    spark: SparkSession,
    path: str,
    kind: str = "input",
    schema: T.StructType | str | None = None,
    infer: bool = False,
    multiline: bool = False,
    suffixes: tuple[str, ...] = (".csv", ".tsv", ".parquet"),
    max_columns: int = MAX_COLUMNS,
) -> DataFrame:
    """Read a table by the suffix of its path.

    Without a schema the columns of a text table are strings, which is what
    identifiers need; ``infer=True`` costs one more pass over the data. Words for
    "missing" become NULL in every string column of a text table. ``multiline`` is
    for quoted line breaks; such a file is read by one task.
    """
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in suffixes:
        raise ValueError(f"Unsupported file type for {kind}: '{suffix}'. Supported: {', '.join(suffixes)}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        if suffix == ".parquet":
            return reader.parquet(path)
        table = reader.csv(
            path,
            sep=_SEPARATORS[suffix],
            header=True,
            inferSchema=infer and schema is None,
            enforceSchema=False,
            quote='"',
            escape='"',
            maxColumns=max_columns,
            multiLine=multiline,
        )
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"{kind.capitalize()} path does not exist: {path}") from error
        raise ValueError(f"Failed to read {kind} '{path}': {error}") from error
    return decode_missing_words(table)


def decode_missing_words(df: DataFrame) -> DataFrame:
    """Turn words for "missing" into NULL in every string column."""
    return df.select(
        *[
            decode_missing(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def require_rows(df: DataFrame, kind: str) -> DataFrame:
    """The table itself; an empty one raises."""
    if df.isEmpty():
        raise ValueError(f"{kind.capitalize()} table is empty")
    return df


def read_response(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Response table (.csv, .tsv or .parquet), any layout, not empty."""
    return require_rows(read_table(spark, path, "response", schema), "response")


def read_metadata(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Model metadata from CSV; identifiers stay text."""
    return read_table(spark, path, "metadata", schema, suffixes=(".csv",))


def split_cells(line: Column) -> Column:
    """Cells of a CSV line: commas inside double quotes do not part, quotes are taken off, doubled ones become one.

    A comma is put in front, so that every match of the pattern begins with one; possessive repeats keep it linear.
    """
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(',("[^"]*+(?:""[^"]*+)*+"|[^,]*+)'), F.lit(1))
    quoted = lambda c: F.startswith(c, F.lit('"')) & F.endswith(c, F.lit('"')) & (F.length(c) > 1)
    return F.transform(raw, lambda c: F.when(quoted(c), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """Records ``(file, first, record)`` of CSV files in which quoted cells may hold line breaks; files are still read in many parts.

    Whether a part of a file begins inside quotes is told by the number of quotes before it: a first pass counts them per part, and
    sums over the parts of a file give each part's start. In the second pass every task cuts its lines into records. What a part
    begins with of a record of an earlier part, and what it ends with of one that goes on, are pieces; only pieces are shuffled, and
    put together in order. ``first`` marks a file's first record. A quote that is never closed makes the rest of its file one record.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value"
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counts = lines.groupBy("file", "at").agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "at", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    # a row per part of a file, some tens of bytes for what a task reads
    marked = lines.join(F.broadcast(starts), ["file", "at"])
    schema = "file string, at bigint, nr bigint, kind string, first boolean, record string"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, nr, inside, kind, rows, size = None, [], 0, False, "whole", [], 0

        def piece(kind: str) -> tuple:
            return (*part, nr, kind, part[1] == 0 and nr == 0, "\n".join(held))

        for batch in batches:
            for file, at, value, within in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "value", "inside")), strict=True):
                if (file, at) != part:
                    if held:
                        rows.append(piece("head" if kind == "whole" else "middle"))
                    part, held, nr, inside = (file, at), [], 0, within
                    kind = "tail" if within else "whole"
                held.append(value)
                size += len(value)
                inside ^= value.count('"') % 2 == 1
                if not inside:
                    rows.append(piece(kind))
                    held, nr, kind = [], nr + 1, "whole"
                if rows and size > _RECORD_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
                    rows, size = [], 0
        if held:
            rows.append(piece("head" if kind == "whole" else "middle"))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    found = materialise(marked.mapInArrow(run, schema))
    pieces = found.where("kind <> 'whole'")
    # a record is known by where its head stands; parts it runs through, and the one it ends in, follow in order
    upto = Window.partitionBy("file").orderBy("at", "nr")
    numbered = pieces.withColumn("begun", F.last(F.when(F.col("kind") == "head", F.col("at")), ignorenulls=True).over(upto))
    joined = numbered.groupBy("file", "begun").agg(F.sort_array(F.collect_list(F.struct("at", "nr", "record"))).alias("p"), F.max("first").alias("first"))
    long = joined.select("file", "first", F.array_join("p.record", "\n").alias("record"))
    ended = F.regexp_replace("record", "\r$", "")
    return found.where("kind = 'whole'").select("file", "first", "record").unionByName(long).select("file", "first", ended.alias("record")).where("record <> ''")


def read_expression_csv(spark: SparkSession, path: str, id_name: str, id_alias: str = "model_id", multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """Wide expression CSV to ``(id, features ARRAY<DOUBLE>)`` plus ``(pos, feature)``.

    Lines are read whole and split by one expression, so that tens of thousands of gene columns never become columns of a
    plan; only the header line reaches the driver. Quoted cells and headers are understood; line breaks inside quotes are with
    ``multiline``, which reads the files twice (:func:`quoted_records`). Each file's first line is its header. A line with more or fewer cells than the header raises with its beginning.
    """
    if os.path.splitext(path.rstrip("/"))[1].lower() != ".csv":
        raise ValueError(f"The expression matrix must be a .csv path, got: {path}")
    records = quoted_records(spark, path) if multiline else None
    first = spark.read.text(path).first() if records is None else records.where("first").select(F.col("record").alias("value")).first()
    if first is None:
        raise ValueError("Expression table is empty")
    names = next(csv.reader(first["value"].splitlines(keepends=True)))
    if id_name not in names:
        raise ValueError(f"The expression table has no column {id_name!r}")
    id_pos = names.index(id_name)
    # no separator and no quote: a line is one column, and Spark leaves out each file's header
    if records is None:
        lines = spark.read.schema("value string").csv(path, sep="\u0001", quote="", header=True, enforceSchema=True, maxCharsPerColumn=-1)
    else:
        lines = records.where("NOT first").select(F.col("record").alias("value"))
    cells = split_cells(F.col("value"))
    checked = lines.select("value", cells.alias("found")).select(
        F.when(F.size("found") == len(names), F.col("found"))
        .otherwise(F.raise_error(F.format_string(f"a line has %d cells, its header {len(names)}: %s", F.size("found"), F.left("value", F.lit(60)))))
        .alias("cells")
    )
    values = F.filter(F.col("cells"), lambda _, i: i != id_pos)
    matrix = checked.select(
        decode_missing(F.col("cells")[id_pos]).alias(id_alias),
        F.transform(values, lambda cell: to_number(cell)).alias("features"),
    )
    kept = [name for at, name in enumerate(names) if at != id_pos]
    return require_rows(matrix, "expression"), feature_positions(spark, kept)


def feature_positions(spark: SparkSession, names: list[str]) -> DataFrame:
    """``(pos, feature)`` for an ordered list of feature names (a header, so driver-sized)."""
    return spark.createDataFrame(list(enumerate(names)), "pos int, feature string")


def pack_features(df: DataFrame, id_col: str, id_alias: str = "model_id") -> tuple[DataFrame, DataFrame]:
    """Wide numeric columns to one array per row plus ``(pos, feature)``."""
    names = [c for c in df.columns if c != id_col]
    if not names:
        raise ValueError("No feature column left beside the identifier")
    packed = df.select(
        F.col(f"`{id_col}`").alias(id_alias),
        F.array(*[F.col(f"`{c}`").cast("double") for c in names]).alias("features"),
    )
    return packed, feature_positions(df.sparkSession, names)


def read_entity_dataset(spark: SparkSession, path: str, schema: T.StructType | str, slug: str | None = None) -> DataFrame:
    """Per-entity dataset; a slug prunes to that entity's partition.

    The schema is given, so that a numeric-looking slug is not read as a number.
    """
    table = spark.read.schema(schema).parquet(path)
    chosen = table if slug is None else table.where(F.col("drug_slug") == (slug or EMPTY_ENTITY))
    if "drug_slug" not in table.columns:
        return chosen
    return chosen.withColumn("drug_slug", F.when(F.col("drug_slug") == EMPTY_ENTITY, "").otherwise(F.col("drug_slug")))


def read_gene_list(spark: SparkSession, path: str) -> DataFrame:
    """One symbol per line: stripped, blank lines dropped; an empty list raises."""
    symbols = spark.read.text(path).select(strip_blank(F.col("value")).alias("symbol")).where("symbol <> ''")
    return require_rows(symbols, "gene list")


def read_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON objects (one per line, or one object spread over lines when it is a single file).

    Spark keeps what is not an object as a corrupt record; that raises here.
    """
    multi = path.rstrip("/").lower().endswith(".json")
    reader = spark.read if schema is None else spark.read.schema(schema)
    records = reader.json(path, multiLine=multi, mode="FAILFAST")
    return records


MODEL_SCHEMA = "l1_ratio double, alpha double, intercept double, coefficients array<double>, features array<string>, target string"


def read_models(spark: SparkSession, path: str, entity: str = "drug_slug", kind: str = "string") -> DataFrame:
    """Stored models, a row per entity."""
    return spark.read.schema(f"`{entity}` {kind}, {MODEL_SCHEMA}").parquet(path)
