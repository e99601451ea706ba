"""An elastic net on thousands of features, held to its optimality conditions by a pass over the data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dosewise.catalog.registry import ORACLES, Inputs, query
from dosewise.operators import elasticnet
from dosewise.operators.matrices import lists
from dosewise.plans import dataset, interpretation
from dosewise.session import bound_batches, let_go, materialise

#: Features: the words that most documents have.
N_WORDS = 4000
L1_RATIO, ALPHA = 0.5, 400.0


#: Cells that a task gathers before it turns columns into rows.
_TURNED = 1 << 20


#: Bytes of text that a task splits at once.
_SPLIT_BYTES = 4 << 20


def _lower(documents: DataFrame) -> DataFrame:
    return documents.withColumn("text", F.lower("text"))


def _parts(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Batches in parts of few bytes of text, with the words of each row. Words end at blanks and line feeds; empty ones are among them."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.unique(np.concatenate([[0], np.searchsorted(sizes, np.arange(_SPLIT_BYTES, sizes[-1] if len(sizes) else 0, _SPLIT_BYTES)), [len(sizes)]]))
        for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            part = batch.slice(first, last - first)
            yield part, pc.split_pattern(pc.replace_substring(part.column(text), "\n", " "), " ")


def _cells(words: pa.Array, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, codes and times of the different codes of each row, ordered by both; a code below 0 is left out."""
    row = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
    kept = codes >= 0
    row, codes = row[kept], codes[kept].astype(np.int64)
    width = int(codes.max(initial=0)) + 1
    found, times = np.unique(row * width + codes, return_counts=True)
    return found // width, found % width, times


def _frequent(documents: DataFrame, vocabulary: list[str], target: str) -> DataFrame:
    """``doc_id, lang``, the target and how often each word of a short list stands in the text, as sparse features."""
    bound_batches(documents.sparkSession)
    schema = f"doc_id bigint, lang string, {target} double, features struct<places:array<int>,values:array<double>>"
    wanted = pa.array(vocabulary, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in _parts(batches, 3):
            codes = pc.fill_null(pc.index_in(words.flatten(), value_set=wanted), -1).to_numpy(zero_copy_only=False)
            row, places, times = _cells(words, codes)
            offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            parts = pa.ListArray.from_arrays(offsets, pa.array(places.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(times.astype(float)))
            features = pa.StructArray.from_arrays(parts, names=["places", "values"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], features], names=["doc_id", "lang", target, "features"])

    return _lower(documents.select("doc_id", "lang", target, "text")).mapInArrow(run, schema)


def _postings(documents: DataFrame) -> DataFrame:
    """``lang, word, known, docs, times``: in which documents a word stands and how often; a row for each word of a batch of documents.
    Documents are told by the difference of their id to the one before; those without an id are not ``known``."""
    bound_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in _parts(batches, 2):
            coded = words.flatten().dictionary_encode()
            nothing = pc.fill_null(pc.equal(coded.dictionary, ""), True).to_numpy(zero_copy_only=False)
            codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
            codes = np.where(np.append(nothing, True)[codes], -1, codes)
            row, code, times = _cells(words, codes)
            lang = batch.column(1).dictionary_encode()
            tongue = pc.fill_null(lang.indices, len(lang.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
            named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = pc.fill_null(batch.column(0), 0).to_numpy()
            key = (tongue[row] * (len(coded.dictionary) + 1) + code) * 2 + named[row]
            order = np.lexsort((ids[row], key))
            begins = np.flatnonzero(np.diff(key[order], prepend=-1))
            docs = np.diff(ids[row[order]], prepend=0)
            docs[begins] = ids[row[order[begins]]]
            offsets = pa.array(np.append(begins, len(order)).astype(np.int32))
            firsts = order[begins]
            columns = [
                batch.column(1).take(pa.array(row[firsts])),
                coded.dictionary.take(pa.array(code[firsts])),
                pa.array(named[row[firsts]]),
                pa.ListArray.from_arrays(offsets, pa.array(docs)),
                pa.ListArray.from_arrays(offsets, pa.array(times[order].astype(np.int32))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "known", "docs", "times"])

    return _lower(documents.select("doc_id", "lang", "text")).mapInArrow(run, "lang string, word string, known boolean, docs array<bigint>, times array<int>")


def _numbered(postings: DataFrame) -> DataFrame:
    """``lang, task, local, length, known, docs, times``: the postings of a word in one task, and its number among the words of its
    language there."""
    bound_batches(postings.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, number = TaskContext.get().partitionId(), (None, None), -1
        for batch in batches:
            if not batch.num_rows:
                continue
            lang, word = batch.column(0), batch.column(1)
            new_lang, new_word = (np.append(True, pc.fill_null(pc.not_equal(c[1:], c[:-1]), True).to_numpy(zero_copy_only=False)) for c in (lang, word))
            first = lang[0].as_py(), word[0].as_py()
            new_lang[0] = number < 0 or first[0] != last[0]
            new = new_lang | new_word
            new[0] = new_lang[0] or first[1] != last[1]
            counted = np.cumsum(new) + (0 if new_lang[0] else number)
            starts = np.maximum.accumulate(np.where(new_lang, np.arange(len(new)), -1))
            local = np.where(starts >= 0, counted - counted[starts], counted)
            last, number = (lang[-1].as_py(), word[-1].as_py()), int(local[-1])
            columns = [lang, pa.array(np.full(len(new), task, np.int32)), pa.array(local.astype(np.int32)), pc.utf8_length(word), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "task", "local", "length", "known", "docs", "times"])

    dealt = postings.where("lang IS NOT NULL").repartition("lang", "word").sortWithinPartitions("lang", "word")
    return dealt.mapInArrow(run, "lang string, task int, local int, length int, known boolean, docs array<bigint>, times array<int>")


def _turned(postings: DataFrame) -> DataFrame:
    """``doc_id, lang, places, times, chars`` of ``lang, pos, length, known, docs, times``: rows of a document for each task, not a row for each
    word in it. ``chars`` is the sum of ``times * length``."""

    def rows(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        lang = table.column("lang").chunk(0).dictionary_encode()
        sizes, times = lists(table.column("times"))
        ids = np.cumsum(lists(table.column("docs"))[1])
        begins = np.cumsum(sizes) - sizes
        doc = ids - np.repeat(np.append(0, ids)[begins], sizes)
        known = np.repeat(table.column("known").to_numpy(), sizes)
        tongue = lang.indices.to_numpy()
        places, length = (np.repeat(table.column(c).to_numpy(), sizes) for c in ("pos", "length"))
        tongue = np.repeat(tongue, sizes)
        order = np.lexsort((places, tongue, doc, known))
        changes = [np.diff(key[order].astype(np.int64), prepend=-1) != 0 for key in (tongue, doc, known)]
        begins = np.flatnonzero(np.append(True, np.logical_or.reduce(changes)[1:]))
        firsts, offsets = order[begins], pa.array(np.append(begins, len(order)).astype(np.int32))
        columns = [
            pa.array(doc[firsts], mask=~known[firsts]),
            lang.dictionary.take(pa.array(tongue[firsts])),
            pa.ListArray.from_arrays(offsets, pa.array(places[order].astype(np.int32))),
            pa.ListArray.from_arrays(offsets, pa.array(times[order].astype(np.int32))),
            pa.array(np.add.reduceat((times * length)[order], begins).astype(np.int64)),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", "places", "times", "chars"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cells = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                cells += len(batch.column(5).flatten())
            if cells >= _TURNED:
                yield from rows(held)
                held, cells = [], 0
        if held:
            yield from rows(held)

    return postings.select("lang", "pos", "length", "known", "docs", "times").mapInArrow(run, "doc_id bigint, lang string, places array<int>, times array<int>, chars bigint")


def _shares(documents: DataFrame) -> DataFrame:
    """``doc_id, lang, word_length, features`` of documents whose cells are lists of ``places`` and ``times`` in any order, a place twice
    where an id has several texts: the shares of their words as sparse features, and the mean length of a word."""
    bound_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, places = lists(batch.column(2))
            times = lists(batch.column(3))[1]
            row = np.repeat(np.arange(len(sizes)), sizes)
            count = np.bincount(row, times, len(sizes))
            order = np.lexsort((places, row))
            places, times = places[order], times[order]
            begins = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(places) != 0))[: len(row)])
            row, places, times = row[begins], places[begins], np.add.reduceat(times, begins) if len(begins) else times
            offsets = pa.array(np.searchsorted(row, np.arange(len(sizes) + 1)).astype(np.int32))
            parts = pa.ListArray.from_arrays(offsets, pa.array(places)), pa.ListArray.from_arrays(offsets, pa.array(times / count[row]))
            features = pa.StructArray.from_arrays(parts, names=["places", "values"])
            length = pa.array(batch.column(4).to_numpy() / count)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], length, features], names=["doc_id", "lang", "word_length", "features"])

    cells = documents.select("doc_id", "lang", "places", "times", "chars")
    return cells.mapInArrow(run, "doc_id bigint, lang string, word_length double, features struct<places:array<int>,values:array<double>>")


@query(
    "elasticnet_wide",
    f"SELECT lang, count(*) AS n_rows, CAST({N_WORDS} AS BIGINT) AS n_features, true AS converged, true AS some_weights, true AS optimal FROM documents GROUP BY lang",
)
def _wide(t: Inputs) -> DataFrame:
    """Text length from word counts, by language; the result says whether every weight meets its condition.

    The conditions are computed anew from the sparse counts and the residuals, apart from the solver: the slope of a weight
    that is not 0 equals the penalty with its sign, that of a weight of 0 does not exceed it.
    """
    documents = t.table("documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars"), "text")
    words = documents.select(F.explode(F.array_distinct(F.split(F.lower("text"), "[ \n]+"))).alias("word")).where("word <> ''")
    spread = words.groupBy("word").agg(F.count("*").alias("docs")).orderBy(F.desc("docs"), "word").limit(N_WORDS)
    rows = materialise(_frequent(documents, [r["word"] for r in spread.collect()], "n_chars"))
    factors = materialise(elasticnet.fold_factors(rows, "lang", N_WORDS, target="n_chars"))
    scaler = materialise(elasticnet.scaler_of(factors, "lang"))
    penalty = factors.select("lang").distinct().select("lang", F.lit(L1_RATIO).alias("l1_ratio"), F.lit(ALPHA).alias("alpha"))
    model = materialise(elasticnet.fit(factors, penalty, "lang"))
    raw = materialise(elasticnet.raw_model(model, scaler, "lang").select("lang", "intercept", F.col("coefficients").alias("slopes")))
    part = F.aggregate(F.zip_with("features.places", "features.values", lambda pos, times: times * F.get("slopes", pos)), F.lit(0.0), lambda a, b: a + b)
    residual = rows.join(raw, "lang").select("lang", "features", (F.col("n_chars") - F.col("intercept") - part).alias("residual"))
    sizes = residual.groupBy("lang").agg(F.count("*").alias("n_rows"), F.sum("residual").alias("rest"))
    cells = residual.select("lang", "residual", F.explode(F.arrays_zip("features.places", "features.values")).alias("cell"))
    pulls = cells.groupBy("lang", F.col("cell.places").alias("pos")).agg(F.sum(F.col("cell.values") * F.col("residual")).alias("pull"))
    weights = model.select("lang", "converged", F.posexplode("coefficients").alias("pos", "w"))
    joined = weights.join(scaler, ["lang", "pos"]).join(pulls, ["lang", "pos"], "left").join(sizes, "lang")
    slope = (F.coalesce("pull", F.lit(0.0)) - F.col("mean") * F.col("rest")) / F.col("scale") / F.col("n_rows") - ALPHA * (1 - L1_RATIO) * F.col("w")
    bound = ALPHA * L1_RATIO
    gap = F.when(F.col("w") == 0, F.greatest(F.abs(slope) - bound, F.lit(0.0))).otherwise(F.abs(slope - bound * F.signum("w")))
    return joined.groupBy("lang", "n_rows").agg(
        F.count("*").alias("n_features"),
        F.every("converged").alias("converged"),
        F.some(F.col("w") != 0).alias("some_weights"),
        ((F.max(gap) < 1e-5) & (F.abs(F.first("rest")) < 1e-4 * F.first("n_rows"))).alias("optimal"),
    ).select("lang", "n_rows", "n_features", "converged", "some_weights", "optimal")


CV_RATIOS, CV_FOLDS_WIDE = [0.5, 0.9], 4
#: 20 penalties, in equal steps of their logarithm.
CV_ALPHAS = np.geomspace(1.0, 0.1, 20).tolist()


@query("elasticnet_cv_wide")
def _cv_wide(t: Inputs) -> DataFrame:
    """Mean word length from the shares of all words of a language, searched over penalties and folds; the rows of the selected
    penalty are marked. Too much for plain SQL; a test holds it to another solver."""
    words = materialise(_numbered(_postings(t.table("documents"))))
    counts = words.groupBy("lang", "task").agg((F.max("local") + 1).alias("n"), F.sum(F.size("docs")).alias("cells"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("task")) - F.col("n")
    starts = materialise(counts.select("lang", "task", "n", "cells", before.alias("before")))
    most = starts.groupBy("lang").agg(F.sum("n").alias("n"), F.sum("cells").alias("cells")).agg(F.max("n"), F.max("cells")).first()
    width, cells = most[0] or 1, most[1] or 0
    found = words.join(starts.select("lang", "task", "before"), ["lang", "task"]).withColumn("pos", (F.col("before") + F.col("local")).cast("int"))
    lists_of = _turned(found).groupBy("doc_id", "lang").agg(F.collect_list(F.struct("places", "times")).alias("c"), F.sum("chars").alias("chars"))
    rows = _shares(lists_of.select("doc_id", "lang", F.flatten("c.places").alias("places"), F.flatten("c.times").alias("times"), "chars"))
    dealt = rows.withColumn("fold", F.pmod("doc_id", F.lit(CV_FOLDS_WIDE)))
    if merge := cells > width * (width + 1) // 4:  # only then are rows read more than once
        dealt = materialise(dealt)
    factors = materialise(elasticnet.fold_factors(dealt, "lang", width, target="word_length", merge=merge))
    let_go(t.spark)
    errors = materialise(elasticnet.errors_of(elasticnet.search(factors, "lang", CV_RATIOS, alphas=CV_ALPHAS, spread=True), "lang"))
    chosen = elasticnet.select_penalty(errors, "lang").select("lang", "l1_ratio", "alpha", F.lit(True).alias("selected"))
    marked = errors.join(chosen, ["lang", "l1_ratio", "alpha"], "left")
    return marked.select("lang", "l1_ratio", F.round("alpha", 9).alias("alpha"), "fold", F.round("mse", 7).alias("mse"), "converged", F.coalesce("selected", F.lit(False)).alias("selected"))


TOP_N = 20


@query("enrichment_top_n")
def _top_n(t: Inputs) -> DataFrame:
    results = interpretation.enrich_top_features(t.coefficients, t.library, "drug_slug", TOP_N, t.table("part").agg(F.count("*")).scalar())
    digits = {"p_value": 8, "adj_p": 8, "odds_ratio": 6, "combined_score": 5}
    return results.withColumns({c: F.round(c, d) for c, d in digits.items()})


_ALL = "SELECT DISTINCT drug_slug, regexp_extract(feature, '^([A-Za-z0-9-]+)', 1) AS symbol FROM coef WHERE coefficient <> 0"
_TOP = f"""SELECT DISTINCT drug_slug, symbol FROM (SELECT drug_slug, regexp_extract(feature, '^([A-Za-z0-9-]+)', 1) AS symbol,
  row_number() OVER (PARTITION BY drug_slug ORDER BY abs(coefficient) DESC, feature) AS nth FROM coef WHERE coefficient <> 0) WHERE nth <= {TOP_N}"""


def register_oracle() -> None:
    """The SQL of ``enrichment`` on the symbols of the top features."""
    from dosewise.catalog import ranking  # noqa: F401

    assert _ALL in ORACLES["enrichment"]
    ORACLES["enrichment_top_n"] = ORACLES["enrichment"].replace(_ALL, _TOP)


register_oracle()


@query(
    "detected_dataset",
    "SELECT assay_id, drug_slug, drug_name, depmap_model_id, round(ln_ic50, 6) AS ln_ic50 FROM ds",
    ("ds",),
)
def _detected(t: Inputs) -> DataFrame:
    response = t.response.select(
        F.col("assay_id").alias("row"), F.col("drug_name").alias("DRUG_NAME"), F.col("cosmic_raw").alias("COSMIC_ID"), F.col("ln_ic50_raw").alias("LN_IC50")
    )
    metadata = t.metadata.select(F.col("model_id").alias("ModelID"), F.col("cosmic_raw").alias("COSMICID"))
    expression = t.expression.select(F.col("model_id").alias("DepMap_ID"), "features")
    rows = dataset.detected_dataset(response, metadata, expression, "row")
    return rows.select("assay_id", "drug_slug", "drug_name", "depmap_model_id", F.round("ln_ic50", 6).alias("ln_ic50"))
