"""Phrase mining, source divergence and URL filters against brute force and hand-made cases."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from dosewise.llm import collocations, divergence, url_filter

NAMES = ["doc_id", "text", "lang", "source", "rank", "block", "phrase", "w0"]
SCHEMA = StructType([StructField("doc_id", LongType()), *(StructField(n, StringType()) for n in NAMES[1:])])


@pytest.fixture(scope="module")
def texts(spark):
    """Make a documents table whose extra columns clash with names that the operators use."""

    def make(rows):
        return spark.createDataFrame([(i, t, lang, source, "x", "y", "z", "v") for i, (t, lang, source) in enumerate(rows)], SCHEMA)

    return make


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_phrases(rows, support, longest, top):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, own in counts.items():
        held = {p: a for p, a in own.items() if len(p) > 1 and a >= support}
        hidden = {p[i:j] for p, f in held.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and f >= own[p[i:j]]}
        found = []
        for p, a in held.items():
            if p in hidden:
                continue
            score, k = min((1000 * a * totals[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def random_rows(seed, n=160):
    draw = random.Random(seed)
    fixed = ["alpha beta gamma delta", "beta gamma", "Über die Brücke", "one two three four five six", "ß ﬀ"]
    rows = []
    for _ in range(n):
        words = [draw.choice(["a", "B", "c,", "d\t", "e.", "f  g", "h\x00i", "日本", draw.choice(fixed), draw.choice(fixed)]) for _ in range(draw.randrange(0, 40))]
        rows.append((" ".join(words), draw.choice(["en", "de", None, "und", ""]), draw.choice(["s1", "s2", "S3", None, "", "ü"])))
    return rows


@pytest.mark.parametrize("sample, lowered, blocks", [(2, 0.5, 1 << 16), (10, 3.0, 1 << 16), (3, 0.6, 1), (1_000_000_000, 1.0, 1 << 16)])
def test_phrases_by_brute_force(texts, sample, lowered, blocks):
    """Also with samples that propose too little or nothing, so that expansion passes run, and with a filter that is full."""
    rows = [*random_rows(1), (None, "en", "s1"), ("", "en", "s1"), ("word", None, None)]
    found = collocations.mine(texts(rows), support=8, top=50, sample=sample, lowered=lowered, blocks=blocks)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute_phrases(rows, 8, 5, 50)


def test_phrases_of_long_texts(texts, monkeypatch):
    """Stretches of a text are counted apart, and runs that reach over an end once."""
    draw = random.Random(3)
    long = " ".join(draw.choice("a b c d e".split()) for _ in range(7000))
    rows = [(long, "en", "s"), ("x " * 3000, "en", "s"), (long, "en", "s"), ("y" * 50_000 + " z", "en", "s")]
    data = collocations._cleaned([long.encode()])
    starts, ends, followed = collocations._words(data)
    assert len(starts) == 7000 and followed[:-1].all() and not followed[-1]
    hashed = collocations._hashes(data, starts, ends, 1)
    whole = {k: h[c] for k, h, c in collocations._runs(hashed, followed, 5, [])}
    apart = defaultdict(list)
    for first in range(0, 7000, 1000):
        part = slice(first, first + 1004)
        for k, h, c in collocations._runs(hashed[part], followed[part], 5, []):
            apart[k] += h[:1000][c[:1000]].tolist()
    assert {k: v.tolist() for k, v in whole.items()} == apart
    assert sorted(map(tuple, collocations.mine(texts(rows), support=20, top=100).collect())) == brute_phrases(rows, 20, 5, 100)


def test_phrases_of_nothing(texts):
    assert collocations.mine(texts([])).count() == 0
    assert collocations.mine(texts([(None, None, None), ("", "en", "s"), ("a b", "en", "s")])).count() == 0


def test_phrase_scores_are_exact(spark):
    draw = random.Random(5)
    rows = []
    for _ in range(300):
        a, more, n = draw.randrange(1, 10 ** draw.randrange(1, 12)), draw.randrange(1, 10 ** draw.randrange(1, 13)), draw.randrange(1, 10 ** draw.randrange(1, 15))
        rows.append((a, a + more + n, a + draw.randrange(more), a + draw.randrange(more)))
    table = spark.createDataFrame(rows, "a bigint, n bigint, l bigint, r bigint")
    d = lambda c: F.col(c).cast("decimal(19,0)")
    for r in table.select("*", collocations.exact_score(d("a"), d("n"), d("l"), d("r")).alias("s")).collect():
        assert r["s"] == 1000 * r["a"] * r["n"] // (r["l"] * r["r"])


def brute_divergence(rows, min_docs, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(text))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, d in docs[lang].items() if d >= min_docs]
        own = sorted(s for x, s in groups if x == lang)
        whole = sum((counts[lang, s] for s in own), Counter())

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in own}, shares(whole)
        for s in own:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in own if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("held", [400_000, 3])
def test_divergence_by_brute_force(texts, monkeypatch, held):
    """With a third of all rows in one source, repeated rows, empty groups, and tasks that pass their counts on early."""
    monkeypatch.setattr(divergence, "HELD", held)
    rows = random_rows(2, 200) + [("hot hot Words of Ärger", "en", "hot")] * 100 + [(None, "en", "none"), ("1 2 3", "xx", "digits"), (None, None, None), ("rare", "xx", "s")]
    found = divergence.audit(texts(rows), min_docs=6, top=7)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert dict(found.dtypes)["value"] == "bigint" and dict(found.dtypes)["rank"] == "int"
    assert sorted(map(tuple, found.collect())) == brute_divergence(rows, 6, 7)


def test_divergence_of_long_texts_and_nothing(texts):
    rows = [("ab " * 500_000 + "c" * 2_000_000, "en", "a"), ("ab cd", "en", "b")] * 3
    assert sorted(map(tuple, divergence.audit(texts(rows), min_docs=3).collect())) == brute_divergence(rows, 3, 50)
    assert divergence.audit(texts([])).count() == 0


def test_tree_shares_paths(spark):
    """Rows of like beginnings, in any number of tasks, give the sums of the pairs over all rows."""
    draw = random.Random(9)
    rows = []
    for _ in range(300):
        path = [(f"s{k:02}", draw.choice([5, 9, 20]), 5) for k in range(12) if draw.random() < 0.6]
        rows.append((draw.choice(["en", "de"]), path, draw.randrange(1, 9)))
    expected = Counter()
    for lang, path, m in rows:
        for j, (b, q, q0) in enumerate(path):
            for a, p, p0 in path[:j]:
                expected[lang, a, b] += m * (abs(p - q) + abs(p0 - q0) - abs(p - q0) - abs(p0 - q))
    table = spark.createDataFrame(rows, "lang string, path array<struct<source: string, p: bigint, p0: bigint>>, m bigint")
    found = Counter()
    for r in divergence.tree_corrections(table).collect():
        found[r["lang"], r["a"], r["b"]] += r["value"]
    assert {k: v for k, v in found.items() if v} == {k: v for k, v in expected.items() if v}


def test_share_is_exact(spark):
    row = spark.range(1).select(divergence.share(F.lit(10**13 + 7), F.lit(10**15 + 3), F.lit(10**9)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (10**13 + 12) // (10**15 + 3 + 5 * 10**9)


URLS = [
    ("http://Example.ORG/es/1", "block"),
    ("https://a.b.example.org/en/19?x=1", "block"),
    ("https://a.b.example.org/en/29", "allow"),
    ("https://notexample.org/es/", "allow"),
    ("http://x.com/fr/#a", "allow"),
    ("http://x.com/de/9", "block"),
    ("http://x.com", "block"),
    ("http://x.com/?utm_source=a&ref=b#top", "block"),
    ("https://www.x.com:443/p?b=2&a=1", "block"),
    ("https://x.com/p?a=1&b=3", "allow"),
    ("//x.com/p?a=1&b=2", "allow"),
    ("x.net/a://x.com/de/1", "block"),
    ("://", "allow"),
    ("", "allow"),
    (None, "allow"),
    ("http://org", "allow"),
    ("http://listed.net/\n/ü?q", "block"),
    ("http://listed.net/" + "a" * 100_000, "block"),
]
LISTED = ["https://x.com/", "http://user@x.com./p?a=1&b=2&utm_medium=z", "listed://www.listed.net:80/\n/ü?q", "ftp://listed.net/" + "a" * 100_000, None, "", "https://x.com", "http://x.com/de/9"]


@pytest.mark.parametrize("most", [1 << 19, 1])
def test_url_rules_and_list(spark, most):
    schema = "page_id bigint, url string, block string, w0 string, filter_block int, entry string, is_listed string"
    rows = [(i, u, "x", "x", 1, "x", "x") for i, (u, _) in enumerate(URLS)]
    listed = spark.createDataFrame([(u,) for u in LISTED], "url string")
    found = url_filter.judge(spark.createDataFrame(rows + rows[:2], schema), listed, url_filter.RULES, most=most)
    by_id = defaultdict(list)
    for r in found.collect():
        by_id[r["page_id"]].append(r["verdict"])
    assert {i: v[0] for i, v in by_id.items()} == {i: v for i, (_, v) in enumerate(URLS)}
    assert [len(by_id[i]) for i in range(4)] == [2, 2, 1, 1]
    rules = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in found.collect()}
    assert rules[0] == ("example.org", "/es/1", "example.org/es/") and rules[1][2] == "example.org/en/1" and rules[2][2] == "org/"
    assert rules[11] == ("x.com", "/de/1", "com/de/") and rules[12] == rules[13] == rules[14] == ("", "", None) and rules[15][2] is None
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "CartesianProduct" not in plan
    empty = spark.createDataFrame([], "url string")
    assert url_filter.judge(spark.createDataFrame([], schema), empty, url_filter.RULES).count() == 0
    nothing = url_filter.judge(spark.createDataFrame(rows, schema), empty, url_filter.RULES)
    assert nothing.where("is_listed").count() == 0 and nothing.count() == len(rows)


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    n = 4000
    listed = spark.range(n).select(F.concat(F.lit("h/"), "id").alias("url"))
    others = spark.range(n, 11 * n).select(F.concat(F.lit("h/"), "id").alias("url"))
    blocks = url_filter.blocks_for(n)
    assert blocks == 256
    table = url_filter.bloom_filter(listed, "url", blocks)
    assert table.count() <= blocks
    assert url_filter.possible(listed, "url", table, blocks, True).count() == n
    assert url_filter.possible(listed, "url", table, blocks, False).count() == 0
    assert url_filter.possible(others, "url", table, blocks, True).count() < 0.02 * 10 * n
