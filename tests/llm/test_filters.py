"""Decontamination, quality rules, ranking, secrets and chat formatting on small tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from dosewise.llm import chat, decontaminate, pairwise_quality, quality_rules, secrets
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma".split()


def lower(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


def hits(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    hit, found = set(), set()
    for item, item_text in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(item_text or ""))
        for k in range(max(1, len(own) - 12) if own else 0):
            window = own[k : k + 13]
            for at in range(len(words) - len(window) + 1):
                if words[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    found.add(str(item if item is not None else ""))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 5])
def test_decontaminate(spark, corpus, block_words):
    long = " ".join(WORDS)
    items = [(1, long), (2, "two words"), (10, "ÉCOLE 7"), (3, ""), (4, None), (None, "null item"), (1, long)]
    texts = ["x " + long.upper() + " y", long[:60], "now Two, words! two-words", None, "", "école 7 École 7", "ÉCOLE.7", "null item " * 40, " ".join(WORDS[2:17]), "junk " * 5000 + long]
    rows = list(enumerate(texts)) + [(None, "two words"), (0, "dup"), (0, "dup")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find(corpus(rows), bench, block_words=block_words).collect()
    want = []
    for doc, text in rows:
        n, hit, found = hits(text, items)
        want.append((doc, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0 and 20 * hit >= n))
    assert sorted(map(str, [tuple(r)[:6] for r in got])) == sorted(map(str, want))
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert [texts[2][s["start"] : s["end"]] for s in spans[2]] == ["Two, words", "two-words"] or [texts[2][s["start"] : s["end"]] for s in spans[2]] == ["Two, words! two-words"]
    assert decontaminate.find(corpus(rows), bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.find(corpus([]), bench).count() == 0
    # a benchmark of many blocks scans in one operator, and one item of many blocks loses no window
    many = spark.createDataFrame([(n, f"item{n} " * 4) for n in range(200)] + [(500, " ".join(f"w{n}" for n in range(700)))], "item_id long, text string")
    docs = [(1, " ".join(f"w{n}" for n in range(650))), (2, "item7 " * 9 + "x item199 item199 item199 item199"), (3, "clean"), (3, "clean")]
    found = decontaminate.find(corpus(docs), many, block_words=30)
    assert sorted((r["doc_id"], r["n_hit"], r["items"]) for r in found.collect()) == [(1, 650, ["500"]), (2, 13, ["199", "7"]), (3, 0, []), (3, 0, [])]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 3  # scan, words, merging


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = set()
    for k in range(len(words) - 4):
        if windows[tuple(words[k : k + 5])] > 1:
            covered.update(range(k, k + 5))
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality_rules(spark, corpus):
    good = "A sentence of some ordinary words that says a thing.\nAnother line, with more of them in it."
    junk = "\n".join(" ".join(f"{w}***" for w in WORDS) for _ in range(3))
    texts = [good, junk, "a b c d e " * 9, "", None, "é x " * 12, "same line here now five\n" * 4, "word " * 4000, good + "\n" + good, "a b c d e f a b c d e g h i j k l m n o p q r s t u v w x y z"]
    rows = list(enumerate(texts)) + [(None, good), (0, good)]
    train = [(100 + k, " ".join(WORDS[k % 5 :]).capitalize() + ".\n" + good) for k in range(20)] + [(200 + k, " ".join(f"{w}{'#$%&'[k % 4] * 3}" for w in WORDS[k % 3 :])) for k in range(20)]
    labels = spark.createDataFrame([(i, int(i < 200)) for i, _ in train] + [(None, 1), (100, None)], "doc_id long, quality int")
    crf = quality_rules.train(corpus(train), labels)
    got = quality_rules.judge(corpus(rows), crf).collect()
    key = lambda r: str(r[0])
    want = sorted([(doc, *brute_counts(text)) for doc, text in rows], key=key)
    assert sorted([tuple(r)[:7] for r in got], key=key) == want
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert kept[0] and not kept[1] and not kept[3] and not kept[4]
    nothing = quality_rules.train(corpus([]), labels)
    assert quality_rules.judge(corpus([]), nothing).count() == 0


def test_quality_rules_train_on_whole_documents(spark, corpus, monkeypatch):
    held = []
    monkeypatch.setattr(quality_rules, "fit", lambda chains, bad: held.extend(zip(map(len, chains), bad, strict=True)))
    late = "\n".join(["a line of plain content as any other"] * 300 + ["CLICK HERE ||| NOW!!!"] * 300)
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int")
    quality_rules.train(corpus([(1, late), (2, "one\ntwo")]), labels)
    assert sorted(held) == [(2, False), (600, True)]
    # rows that repeat count once, and other texts of an id stay within the bounds
    held.clear()
    again = corpus([(1, late)]).crossJoin(spark.range(10_000).select("id")).drop("id")
    quality_rules.train(again.unionByName(corpus([(2, "one\ntwo")])), labels.union(labels))
    assert sorted(held) == [(2, False), (600, True)]
    held.clear()
    monkeypatch.setattr(quality_rules, "TRAIN_DOCS", 40)
    monkeypatch.setattr(quality_rules, "TRAIN_LINES", 30)
    monkeypatch.setattr(quality_rules, "TRAIN_DOC_LINES", 6)
    many = [(1, f"text {n}\nand\nmore") for n in range(100)] + [(2, f"text {n}") for n in range(100)] + [(2, "a\n" * 7)]
    quality_rules.train(corpus(many), labels)
    assert sorted(held) == [(1, False)] * 20 + [(3, True)] * 7


def test_viterbi_is_the_best_path():
    chance = np.random.default_rng(5)
    for _ in range(50):
        n = int(chance.integers(1, 8))
        crf = quality_rules.Crf(chance.normal(size=(len(quality_rules.FEATURES), 2)), chance.normal(size=(2, 2)))
        x = chance.normal(size=(n, len(quality_rules.FEATURES)))
        scores = x @ crf.weights

        def total(labels, scores=scores, crf=crf):
            return sum(scores[t, v] for t, v in enumerate(labels)) + sum(crf.pairs[a, b] for a, b in zip(labels, labels[1:]))

        best = max(total([k >> t & 1 for t in range(n)]) for k in range(1 << n))
        assert total(crf.viterbi(x).tolist()) == pytest.approx(best)


def test_pairwise_quality(spark, corpus):
    rows = [(k, " ".join(WORDS[k % 7 :]) + (f" {k}." if k % 2 else " ***&&&" * 9)) for k in range(120)] + [(500, ""), (501, None), (None, "x"), (1, "twice")]
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = pairwise_quality.rank(corpus(rows), labels).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    import zlib

    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    unseen = [r for r in got if r["held_out"] and r["doc_id"] < 120]
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in unseen) >= 0.95 * len(unseen)
    # labels of held-out rows change nothing
    flipped = labels.withColumn("quality", F.when(pairwise_quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in pairwise_quality.rank(corpus(rows[:120]), flipped).collect()}
    first = {r["doc_id"]: r["score"] for r in pairwise_quality.rank(corpus(rows[:120]), labels).collect()}
    assert again == first
    assert pairwise_quality.rank(corpus([]), labels).count() == 0
    assert {r["score"] for r in pairwise_quality.rank(corpus(rows), labels.where("quality = 1")).collect()} == {0.5}


def test_pairwise_quality_learns_from_all_labels(spark):
    """Every labelled document is in pairs with the other label, however uneven the labels are, and the threshold is exact."""
    chance = np.random.default_rng(3)
    for n in ({1: 2500, 0: 30}, {1: 1500, 0: 2600}, {1: 1, 0: 1}):
        rows = [(k, int(k < n[1]), [float(k)]) for k in range(n[1] + n[0])]
        met = pairwise_quality.pairs(spark.createDataFrame(rows, "doc_id long, label int, features array<double>"), n, 2).collect()
        assert len(met) == 2 * len(rows)
        assert {r["better"][0] for r in met} == set(range(n[1])) and {r["worse"][0] for r in met} == set(range(n[1], len(rows)))
    values = np.concatenate((np.round(chance.normal(size=30_000), 3), np.full(500, 0.25), chance.normal(size=20)))
    ordered = np.sort(values)
    held = spark.createDataFrame([(float(x),) for x in values], "s double")
    for below in (1, 7, 12_345, 18_500, len(values) - 1):
        assert pairwise_quality.quantile(held, below, len(values)) == (ordered[below - 1] + ordered[below]) / 2


def test_pairwise_quality_moves_features_once_a_pair(spark, corpus):
    """Features take 4 bytes each, and the sizes of buckets need no exchange of the documents."""
    described = pairwise_quality.describe(corpus([(1, "some text")]))
    assert dict(described.dtypes)["features"] == "array<float>"
    known = spark.range(6000).selectExpr("id as doc_id", "cast(id % 2 as int) as label", "array_repeat(cast(rand(5) as float), 46) as features")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        plan = pairwise_quality.pairs(known, {0: 3000, 1: 3000})._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == 1


def test_secret_scan(spark, corpus):
    token = lambda k: hashlib.sha1(str(k).encode()).hexdigest()
    rows = [(k, f'é some text then token = "{token(k)}" and on') for k in range(60)]
    rows += [(100 + k, f"paid with {4000000000000000 + 7919 * k} in the shop") for k in range(60)]
    rows += [(200, None), (201, ""), (None, f'token = "{token(9)}"'), (0, rows[0][1])]
    got = secrets.scan(corpus(rows), path_col=None).collect()
    assert len(got) == 122
    assert all(r["is_secret"] == bool(re.search("[a-f]", r["finding"])) for r in got)
    texts = dict(rows)
    assert all(texts[r["doc_id"]][r["start"] : r["end"]] == r["finding"] for r in got if r["doc_id"] is not None)
    assert secrets.scan(corpus([]), path_col=None).count() == 0


def test_secret_scan_keeps_rare_positives_and_unknowns(corpus, monkeypatch):
    monkeypatch.setattr(secrets, "TRAIN_FINDINGS", 40)
    token = lambda k: hashlib.sha1(str(k).encode()).hexdigest()
    plain = [(1000 + k, f"paid with {4000000000000000 + 7919 * k} in the shop") for k in range(2000)]
    rows = [(k, f'some text then token = "{token(k)}" and on') for k in range(30)] + plain
    got = secrets.scan(corpus(rows), path_col=None).collect()
    assert len(got) == 2030 and all(r["is_secret"] == (r["doc_id"] < 30) for r in got)
    unknown = secrets.scan(corpus(plain[:20]), path_col=None).collect()
    assert {(r["probability"], r["is_secret"]) for r in unknown} == {(None, None)}


def test_secret_candidates():
    of = lambda text: [text.encode()[a:b].decode() for a, b, _ in secrets.spans(text.encode())]
    assert of('é password = "hunter$2 x" and pwd: Tr0ub4dor&3, done') == ["hunter$2 x", "Tr0ub4dor&3"]
    assert of("postgres://me:s3cr@db and ghp_" + "aBcDeFgHiJkL" * 3) == ["s3cr", "ghp_" + "aBcDeFgHiJkL" * 3]
    assert of("api_key='abc$0123456789abcdef01'") == ["abc$0123456789abcdef01"]
    assert secrets.spans(b'token = "0123456789abcdef0123"') == [(9, 29, "run")]
    assert of("no candidates here, passwords are not assigned") == []


def test_chat(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 2, "assistant", None), (1, 1, "user", "a<b>\\l"), (1, 2, "assistant", "é\n</turn>\n<turn:user>"), (None, 0, "human", "x"), (2, None, None, ""), (2, None, None, "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    records = df.select("conv_id", "turn", F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    for size in (1 << 20, 10):
        chat.CHUNK_CHARS = size
        formatted = chat.format_records(records, 3)
        got = {r["conv_id"]: r for r in chat.digests(formatted, 3).collect()}
        digest = lambda turns: hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert got[-7]["turns_sha256"] == digest([("user", said), ("assistant", said)])
        assert got[-7]["loss_chars"] == len(said) and got[-7]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == len("é\n</turn>\n<turn:user>")
        assert got[None]["turns_sha256"] == digest([("user", "x")])
        assert got[2]["turns_sha256"] == digest([("", ""), ("", "")])
        assert (formatted.where("conv_id = 1").count() > 1) == (size == 10)
    chat.CHUNK_CHARS = 1 << 20
    assert chat.digests(chat.format_records(records.limit(0), 2), 2).count() == 0


def test_chat_layouts(spark):
    import json

    layouts = [
        {"prompt": "p", "completion": "c"},
        {"instruction": "i", "input": "", "output": "o"},
        {"instruction": "i", "input": "n", "output": "o"},
        {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]},
        {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": None}]},
        {"unknown": {"deep": [1]}},
    ]
    found = [chat.canonical(json.dumps(x), chat.registry())[1] for x in layouts]
    assert found == [
        [("user", "p"), ("assistant", "c")],
        [("user", "i"), ("assistant", "o")],
        [("user", "i"), ("user", "n"), ("assistant", "o")],
        [("system", "s"), ("user", "u")],
        [("user", "h"), ("assistant", "")],
        None,
    ]
    df = spark.createDataFrame([(json.dumps(x),) for x in layouts] + [("no json",), (None,)], "record string")
    odd = {r["fingerprint"]: r["n_records"] for r in chat.unmapped(df).collect()}
    assert sorted(odd.values()) == [1, 2] and odd[""] == 2
