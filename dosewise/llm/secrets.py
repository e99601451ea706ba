"""Secret scans with a random forest that removes false positives.

Candidates are long runs of letters, digits and a few signs with a digit in them, values of any length and any signs that are
assigned to a name of a secret, and strings of a known token's shape. A finding is described by its length,
entropy, transitions between kinds of characters, how much of it dictionary words cover, its path and the words around it. A
random forest (Spark's) trained from labelled findings gives each candidate a probability; what stays below the threshold
is removed as a false positive.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import arrow_schema, quoted, text_bytes

#: Fixed by the operator: what a candidate looks like, in bytes; 16 characters at least.
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=.\-]{16,}")
#: Values assigned to a name of a secret: quoted, or up to white space or a quote.
ASSIGNED = re.compile(
    rb"(?i:token|secret|passw(?:or)?d|passphrase|pwd|(?:api|access|private)[_\- ]?key|auth|credential)[A-Za-z0-9_\-]{0,40}[\"']?[ \t]{0,3}(?::=|=>|[:=])[ \t]{0,3}"
    rb"(?:\"((?:[^\"\\\n]|\\.)+)\"|'((?:[^'\\\n]|\\.)+)'|([^\s\"']+))"
)
#: Shapes of well-known tokens, with or without digits, and the password of a URL (the group).
KNOWN = re.compile(
    rb"(?:AKIA|ASIA)[0-9A-Z]{16}\b|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\w{22,}|glpat-[\w\-]{20,}|xox[abeoprs]-[A-Za-z0-9\-]{10,}|sk[_-][A-Za-z0-9_\-]{20,}"
    rb"|AIza[\w\-]{35}|eyJ[\w\-]{8,}\.eyJ[\w\-]{8,}\.[\w\-]*|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----|://[^\s/:@]{1,256}:([^\s/@]+)@"
)
#: Words around a candidate that are read on either side, in bytes.
NEAR = 48
#: Words of the dictionary: the corpus's most frequent of four letters and more. A bound of a feature table.
DICTIONARY = 5000
#: Labelled findings that a forest is trained on at most, half of them of each label.
TRAIN_FINDINGS = 50_000
TREES, DEPTH, SEED = 24, 8, 11
#: Words that often stand before a secret or a harmless string (fixed values).
SECRET_WORDS = (b"token", b"secret", b"password", b"passwd", b"key", b"auth", b"bearer", b"credential", b"private", b"api")
PLAIN_WORDS = (b"sha", b"md5", b"hash", b"commit", b"uuid", b"version", b"example", b"sample", b"test", b"checksum", b"http", b"www")
_HEX = re.compile(rb"[0-9a-f]+\Z|[0-9A-F]+\Z")
_WORD = re.compile(rb"[a-z]{4,}")
N_FEATURES = 22


def _kind(byte: int) -> int:
    return 0 if 0x61 <= byte <= 0x7A else 1 if 0x41 <= byte <= 0x5A else 2 if 0x30 <= byte <= 0x39 else 3


def describe_candidate(value: bytes, before: bytes, after: bytes, path: bytes, dictionary: frozenset[bytes]) -> list[float]:
    n = len(value)
    kinds = [_kind(b) for b in value]
    counts = Counter(value)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    moves = Counter(zip(kinds, kinds[1:]))
    changes = sum(c for (a, b), c in moves.items() if a != b)
    covered = sum(len(w) for w in _WORD.findall(value.lower()) if w in dictionary)
    near = before.lower()
    lower_path = path.lower()
    return [
        float(min(n, 256)),
        entropy,
        kinds.count(0) / n,
        kinds.count(1) / n,
        kinds.count(2) / n,
        kinds.count(3) / n,
        changes / max(n - 1, 1),
        (moves[0, 2] + moves[2, 0]) / max(n - 1, 1),
        (moves[0, 1] + moves[1, 0]) / max(n - 1, 1),
        (moves[2, 2]) / max(n - 1, 1),
        sum(map(int.__eq__, value, value[1:])) / max(n - 1, 1),
        sum(1 for a, b in zip(value, value[1:]) if b - a == 1) / max(n - 1, 1),
        len(counts) / min(n, 64),
        1.0 if _HEX.match(value) else 0.0,
        covered / n,
        float(any(w in near for w in SECRET_WORDS)),
        float(any(w in near for w in PLAIN_WORDS)),
        float(near.rstrip()[-1:] in b"=:\"'" and near.strip() != b""),
        float(near[-1:] in b"\"'" and near != b"" and after[:1] in b"\"'" and after != b""),
        float(lower_path.count(b"/")),
        float(any(w in lower_path for w in (b"test", b"example", b"doc", b"sample"))),
        float(value.count(b"/") + value.count(b".")),
    ]


def dictionary(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> frozenset[bytes]:
    """The most frequent lower-case words of four ASCII letters and more, counted over all whole texts."""
    words = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col(quoted(text_col)), F.lit(""))), " ", -1)).alias("word"))
    plain = words.where(F.col("word").rlike("^[a-z]{4,24}$"))
    top = plain.groupBy("word").count().orderBy(F.desc("count"), "word").limit(size)
    return frozenset(r["word"].encode() for r in top.collect())


def spans(text: bytes) -> list[tuple[int, int, str]]:
    """``start, end, rule`` of all candidates in bytes, by start: ``known`` for a known token's shape, ``run`` for a long run, else
    ``assigned``. A run inside a longer assigned value or known token is no candidate of its own; others may overlap."""
    wide = {}
    for m in ASSIGNED.finditer(text):
        group = m.lastindex
        end = m.start(group) + len(m.group(3).rstrip(b",;.") or m.group(3)) if group == 3 else m.end(group)
        wide[m.start(group), end] = "assigned"
    for m in KNOWN.finditer(text):
        wide[m.span(m.lastindex or 0)] = "known"
    out, holders, at, reach = dict(wide), sorted(wide), 0, 0
    for m in CANDIDATE.finditer(text):
        value = m.group().rstrip(b".=-_/+") if not m.group().endswith(b"=") else m.group()
        if len(value) < 16 or not any(0x30 <= b <= 0x39 for b in value):
            continue
        a, b = m.start(), m.start() + len(value)
        while at < len(holders) and holders[at][0] <= a:
            reach = max(reach, holders[at][1])
            at += 1
        if (a, b) in wide:
            out[a, b] = "known" if wide[a, b] == "known" else "run"
        elif b > reach:
            out[a, b] = "run"
    return sorted((a, b, rule) for (a, b), rule in out.items())


def candidates(docs: DataFrame, known: frozenset[bytes], id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """``doc_id, start, end`` (characters), ``finding, rule, before, features`` of every candidate of every whole text.

    Null and empty texts have none. Rows are independent; a repeated row repeats its candidates. A null path is empty.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    path = F.coalesce(F.col(quoted(path_col)).cast("string"), F.lit("")) if path_col in docs.columns else F.lit("")
    schema_text = f"doc_id {kind}, start bigint, end bigint, finding string, rule string, before string, features array<double>"
    schema = arrow_schema(spark, schema_text)
    shared = spark.sparkContext.broadcast(known)

    def run(batches):
        import pyarrow as pa

        words = shared.value
        for batch in batches:
            rows = []
            for doc, text, where in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                at_byte = at_char = 0
                for a, b, rule in spans(text):
                    value = text[a:b]
                    at_char += len(text[at_byte:a].decode("utf-8", "replace"))
                    at_byte = a
                    before, after = text[max(0, a - NEAR) : a], text[b : b + NEAR]
                    found = describe_candidate(value, before, after, where.encode(), words)
                    finding = value.decode("utf-8", "replace")
                    rows.append((doc, at_char, at_char + len(finding), finding, rule, before.decode("utf-8", "ignore"), found))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col(quoted(id_col)).alias("doc_id"), text_bytes(text_col).alias("text"), path.alias("path")).mapInArrow(run, schema_text)


def train(findings: DataFrame, label_col: str = "label") -> RandomForestClassificationModel | None:
    """A forest from labelled findings (``features`` and a 0/1 label), at most half of ``TRAIN_FINDINGS`` of each label, chosen by
    a hash of the finding and weighted back to the label's number; None if a label is missing. Rows without a label or features
    are left out."""
    rows = findings.where(F.col(label_col).isin(0, 1) & F.col("features").isNotNull())
    totals = {r["label"]: r["count"] for r in rows.groupBy(F.col(label_col).cast("int").alias("label")).count().collect()}
    if len(totals) < 2:
        return None
    picked, most = None, TRAIN_FINDINGS // 2
    for label, total in sorted(totals.items()):
        side = rows.where(F.col(label_col) == label).orderBy(F.xxhash64("finding", "doc_id", "start"), "doc_id", "start").limit(most)
        side = side.select(array_to_vector("features").alias("vector"), F.lit(float(label)).alias("label"), F.lit(total / min(total, most)).alias("weight"))
        picked = side if picked is None else picked.unionByName(side)
    ready = materialise(picked)
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxMemoryInMB=64)
    return forest.fit(ready)


def weak_labels(found: DataFrame) -> DataFrame:
    """Label findings where it is plain what they are: 1 for a quoted hex or mixed string of 20 characters and more that is
    assigned to a name of a secret, 0 for all others whose neighbouring words name no secret, null where unsure. Both are long runs: short assigned values get no label, known tokens never 0."""
    assigned = F.col("before").rlike(r"(?i)(token|secret|password|passwd|api[_-]?key|auth|credential)\W{0,3}[=:]\s*[\"']?$")
    named = F.col("before").rlike(r"(?i)token|secret|passw|api|key|auth|credential|private|bearer")
    return found.withColumn(
        "label",
        F.when(assigned & (F.col("rule") != "assigned") & (F.length("finding") >= 20) & F.col("finding").rlike("[A-Za-z]"), 1).when(~named & (F.col("rule") == "run"), 0),
    )


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """``doc_id, start, end, finding, probability, is_secret`` of every candidate of every whole text.

    ``labelled`` holds findings (as :func:`candidates` gives them) with a label; without it the findings of ``docs`` are
    labelled by :func:`weak_labels`, but for documents with crc32(id as text) mod 3 = 1, which never train and can be used to
    measure. Without two kinds of labels nothing is known: probability and ``is_secret`` are null. Empty tables give an empty result.
    """
    found = materialise(candidates(docs, dictionary(docs, text_col), id_col, text_col, path_col))
    if labelled is None:
        labelled = weak_labels(found).where(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1, F.lit(True)))
    model = train(labelled)
    if model is None:
        scored = found.withColumn("probability", F.lit(None).cast("double"))
    else:
        scored = model.transform(found.withColumn("vector", array_to_vector("features"))).withColumn("probability", vector_to_array("probability")[1])
    return scored.select("doc_id", "start", "end", "finding", "before", "probability", (F.col("probability") >= threshold).alias("is_secret"))
