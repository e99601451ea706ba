"""Document quality by Bradley-Terry ranking.

A document has a strength, linear in features of its text; in a pair, the better one wins with the logistic function of the
difference of strengths. The weights come from preference pairs (a document labelled good against one labelled bad), by
Spark's logistic regression without intercept on feature differences. Every labelled document meets ``OPPONENTS`` documents of the
other label, chosen by a hash, so pairs grow with the labels. The threshold is the exact quantile of all training documents'
strengths: the share of bad labels among them. A score is the logistic function of strength less threshold, so 0.5 is the
threshold.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import map_rows, quoted, text_bytes

#: Documents of the other label that each labelled document meets.
OPPONENTS = 4
#: Labelled documents that are numbered together, and relative error of the sketch that sets a slice about the threshold apart.
BUCKET, ACCURACY = 1000, 10_000

_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_KINDS = {
    "upper": bytes(range(0x41, 0x5B)),
    "lower": bytes(range(0x61, 0x7B)),
    "digit": bytes(range(0x30, 0x3A)),
    "symbol": b"#*$%&|<>",
    "bar": b"|",
    "exclaim": b"!",
    "stop": b".?",
    "comma": b",;:",
    "bracket": b"()[]{}=_/\\\"",
    "beyond": bytes(range(0x80, 0x100)),
}


def features(text: bytes) -> list[float]:
    """Shares of character kinds, word and line statistics and repetition, each of bounded size."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * N_FEATURES
    count = {name: size - len(text.translate(None, kind)) for name, kind in _KINDS.items()}
    lines = [line for line in text.split(b"\n") if line.strip(_SPACE)]
    words_per_line = [len(line.split()) for line in lines]
    frequency = Counter(words)
    top = frequency.most_common(1)[0][1]
    same_as_last = sum(map(bytes.__eq__, words, words[1:]))
    marked = sum(1 for w in words if w[-1:] in b"*$%&#|!<>")
    letters = count["upper"] + count["lower"] + count["beyond"] + 1
    own = [
        min(1.0, np.log1p(n) / 10),
        min(1.0, size / n / 20),
        count["upper"] / letters,
        count["digit"] / size,
        min(1.0, count["symbol"] / n),
        min(1.0, count["bar"] / n),
        min(1.0, count["exclaim"] / n),
        min(1.0, count["stop"] / n),
        min(1.0, count["comma"] / n),
        min(1.0, count["bracket"] / n),
        count["beyond"] / size,
        len(frequency) / n,
        top / n,
        same_as_last / n,
        marked / n,
        min(1.0, max(words_per_line) / 200),
        min(1.0, n / len(lines) / 100),
        1 - len(set(lines)) / len(lines),
        sum(1 for w in words_per_line if w < 4) / len(lines),
        sum(1 for line in lines if line.rstrip()[-1:] in b".?!") / len(lines),
        1.0 if n < 10 else 0.0,
        1.0 if n < 25 else 0.0,
    ]
    return own + [x * x for x in own[:20]] + [min(1.0, 20 * own[4]), min(1.0, 20 * own[6]), min(1.0, 10 * own[13]), min(1.0, 10 * own[17])]


N_FEATURES = 46


def learnable(id_col: str) -> Column:
    """Rows whose labels a fit may use: crc32 of the id as text leaves another remainder by 3 than 1."""
    return ~held_out(id_col)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(quoted(id_col)).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, features`` of every whole text; null texts as empty ones. Features are shares and take 4 bytes each."""

    def make():
        return lambda key, text: (key, features(text))

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(quoted(id_col)).alias("doc_id"), text_bytes(text_col).alias("text")), f"doc_id {kind}, features array<float>", make)


class Ranker:
    """Weights, and the threshold of strengths."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, threshold: float):
        self.mean, self.scale, self.weights, self.threshold = mean, scale, weights, threshold

    def strength(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights

    def of(self, column: Column) -> Column:
        """The strength from a column of features, as one sum in the JVM; ``mean`` moves all alike and is left out."""
        array = F.array(*[F.lit(float(s)) for s in self.weights / self.scale])
        return F.aggregate(F.zip_with(column, array, lambda a, b: a * b), F.lit(0.0), lambda total, part: total + part)

    def score(self, column: Column) -> Column:
        """The score from a column of features."""
        offset = float(self.mean @ (self.weights / self.scale) + self.threshold)
        return 1 / (1 + F.exp(-(self.of(column) - offset)))


def pairs(known: DataFrame, counts: dict[int, int], opponents: int = OPPONENTS) -> DataFrame:
    """``better, worse``: features of a good and a bad document of ``known(doc_id, label, features)``. Every document is in
    ``opponents`` pairs at least, with documents of the other label dealt by a hash: one of a bucket, by its number there."""
    buckets = {label: max(1, count // BUCKET) for label, count in counts.items()}
    bucket_of = lambda label, order: F.pmod(order, F.when(label == 1, buckets[1]).otherwise(buckets[0]))
    # features are part of the order: rows that repeat an id count as often as they stand there
    hashed = known.withColumn("order", F.xxhash64("doc_id", "features"))
    own = Window.partitionBy("label", "bucket")
    numbered = hashed.withColumn("bucket", bucket_of(F.col("label"), F.col("order"))).withColumn("number", F.row_number().over(own.orderBy("order")) - 1)
    numbered = materialise(numbered)
    # written, so that its size is known before the join and the documents need no exchange for it
    sizes = materialise(numbered.groupBy("label", "bucket").agg(F.count("*").alias("size")))
    times = F.explode(F.sequence(F.lit(1), F.lit(opponents)))
    asked = numbered.select((1 - F.col("label")).alias("label"), F.col("features").alias("asker"), "order", F.col("number").alias("own"), times.alias("k"))
    asked = asked.withColumn("bucket", bucket_of(F.col("label"), F.xxhash64("order", "own", "k")))
    asked = asked.join(sizes, ["label", "bucket"]).withColumn("number", F.pmod(F.xxhash64("k", "own", "order"), "size").cast("int"))
    met = asked.select("label", "bucket", "number", "asker").join(numbered.select("label", "bucket", "number", "features"), ["label", "bucket", "number"])
    # the label of the join is that of the opponent
    asker_wins = F.col("label") == 0
    return met.select(F.when(asker_wins, F.col("asker")).otherwise(F.col("features")).alias("better"), F.when(asker_wins, F.col("features")).otherwise(F.col("asker")).alias("worse"))


def quantile(strengths: DataFrame, below: int, total: int) -> float:
    """The mean of the ``below``-th smallest of all ``total`` values in ``strengths(s)`` and the next: exact. A sketch sets a slice
    apart; what lies before it is counted and only its distinct values are ordered."""
    reach = 2.0 / ACCURACY
    at = [max(0.0, below / total - reach), min(1.0, (below + 1) / total + reach)]
    low, high = strengths.agg(F.percentile_approx("s", F.array(*[F.lit(x) for x in at]), ACCURACY)).first()[0]
    # equal strengths are one value with a count, however many documents have it
    slice_ = strengths.where(F.col("s").between(low, high)).groupBy("s").agg(F.count("*").alias("n"))
    before = strengths.where(F.col("s") < low).count()
    reached = before + F.sum("n").over(Window.orderBy("s"))
    ordered = slice_.select("s", reached.alias("reached"))
    first, second = ordered.agg(F.min(F.when(F.col("reached") >= max(1, below), F.col("s"))), F.min(F.when(F.col("reached") >= min(total, below + 1), F.col("s")))).first()
    return (first + second) / 2


def train(described: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Ranker:
    """Fit on all labelled rows of ``described``.

    Only rows that :func:`learnable` allows are used; null ids and labels are left out, of repeated labels each counts. Without one
    of the two labels every document gets the score 0.5.
    """
    own = labels.where(learnable(id_col) & F.col(quoted(label_col)).isin(0, 1)).select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(label_col)).cast("int").alias("label"))
    known = materialise(described.join(own, "doc_id"))
    counts = {0: 0, 1: 0} | {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not min(counts.values()):
        return Ranker(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0)
    moments = known.select(array_to_vector("features").alias("v")).agg(Summarizer.metrics("mean", "variance").summary(F.col("v")).alias("x")).select("x.*").first()
    mean, scale = moments["mean"].toArray(), np.sqrt(moments["variance"].toArray()) + 1e-3
    # each pair is told from either side, so that both classes are there
    by_scale = F.array(*[F.lit(float(x)) for x in scale])
    difference = F.zip_with(F.zip_with("better", "worse", lambda a, b: a - b), by_scale, lambda d, x: d / x)
    won = F.pmod(F.xxhash64("better", "worse"), F.lit(2))
    told = pairs(known, counts).select(difference.alias("d"), won.cast("double").alias("won"))
    told = told.select("won", array_to_vector(F.transform("d", lambda d: d * (2 * F.col("won") - 1))).alias("d"))
    model = LogisticRegression(featuresCol="d", labelCol="won", fitIntercept=False, standardization=False, regParam=1e-3, maxIter=100).fit(told)
    ranker = Ranker(mean, scale, model.coefficients.toArray(), 0.0)
    strengths = materialise(known.select((ranker.of(F.col("features")) - float(mean @ (ranker.weights / scale))).alias("s")))
    ranker.threshold = quantile(strengths, counts[0], sum(counts.values()))
    return ranker


def rank(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``.

    Features are computed once over all whole texts and written; fit and scores read them back. An empty or null text has
    all features 0 and its score like any other; null ids are scored and never held out.
    """
    described = materialise(describe(docs, id_col, text_col))
    ranker = train(described, labels, id_col, label_col)
    scored = described.select("doc_id", held_out("doc_id").alias("held_out"), ranker.score(F.col("features")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
