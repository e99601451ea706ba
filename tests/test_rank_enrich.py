import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from dosewise.operators import enrich, rank
from dosewise.plans import interpretation


@pytest.fixture(scope="module")
def coefficients(spark):
    rng = random.Random(5)
    rows = [("hot", f"G{i} ({i})", rng.choice([0.0, rng.gauss(0, 1), 0.25, -0.25])) for i in range(2000)]
    rows += [("pos", f"P{i} ({i})", float(i + 1)) for i in range(40)] + [("zero", "Z (1)", 0.0), ("same", "S (1)", 2.0), ("same", "T (2)", 2.0)]
    return spark.createDataFrame(rows, "drug_slug string, feature string, coefficient double").cache()


def test_top_lists(coefficients):
    rows = [tuple(r) for r in coefficients.where("drug_slug = 'hot'").collect()]
    expected = sorted((r for r in rows if r[2] > 0), key=lambda r: (-r[2], r[1]))[:25]
    got = rank.top_positive(coefficients, "drug_slug").where("drug_slug = 'hot'").orderBy("rank").collect()
    assert [(r.feature, r.coefficient) for r in got] == [(r[1], r[2]) for r in expected]
    assert rank.top_negative(coefficients, "drug_slug").where("drug_slug = 'pos'").count() == 0
    assert rank.top_features(coefficients, "drug_slug").groupBy("drug_slug").count().where("drug_slug = 'hot'").first()["count"] == 25
    bars = rank.plot_coefficients(coefficients, "drug_slug").where("drug_slug = 'hot'")
    assert {r.sign: r["count"] for r in bars.groupBy("sign").count().collect()} == {"positive": 15, "negative": 15}


def test_summary(coefficients):
    got = {r.drug_slug: r for r in rank.coefficient_summary(coefficients, "drug_slug").collect()}
    assert "zero" not in got
    values = [r.coefficient for r in coefficients.where("drug_slug = 'hot' AND coefficient <> 0").collect()]
    hot = got["hot"]
    assert hot.n_nonzero_features == len(values) == hot.n_positive_coefficients + hot.n_negative_coefficients
    assert (hot.max_positive_coefficient, hot.min_negative_coefficient) == (max(values), min(values))
    assert hot.median_abs_coefficient == statistics.median(map(abs, values))
    assert hot.mean_abs_coefficient == pytest.approx(statistics.fmean(map(abs, values)))
    assert got["pos"].min_negative_coefficient is None and got["pos"].median_abs_coefficient == 20.5


def test_histogram(coefficients):
    bars = rank.coefficient_histogram(coefficients, "drug_slug")
    totals = {r.drug_slug: (r.n, r.bins) for r in bars.groupBy("drug_slug").agg(F.sum("n").alias("n"), F.count("*").alias("bins")).collect()}
    assert totals == {"hot": (2000, 30), "pos": (40, 30), "zero": (1, 30), "same": (2, 30)}
    same = {r.bin: r.n for r in bars.where("drug_slug = 'same'").collect()}
    assert same[0] == 2 and sum(same.values()) == 2
    assert bars.where("drug_slug = 'pos' AND bin = 29").first().n == 2  # the right edge is closed


def test_gene_symbols(coefficients):
    top = rank.gene_symbols_top(coefficients, "drug_slug", 3).where("drug_slug = 'pos'").orderBy("rank").collect()
    assert [r.gene_symbol for r in top] == ["P39", "P38", "P37"]


@pytest.fixture(scope="module")
def library(spark):
    rng = random.Random(9)
    genes = [f"G{i}" for i in range(400)]
    rows = [("big", f"t{t}", g) for t in range(60) for g in rng.sample(genes, rng.choice([5, 5, 20, 60]))]
    rows += [("small", "only", g) for g in genes[:7]] + [("small", "repeat", "G1"), ("small", "repeat", "G1"), ("small", "none", "X")]
    lists = [("a", g) for g in rng.sample(genes, 40)] + [("b", g) for g in genes[:5]] + [("b", "G0"), ("b", None)]
    return (
        spark.createDataFrame(lists, "drug_slug string, symbol string").cache(),
        spark.createDataFrame(rows, "gene_set string, term string, symbol string").cache(),
    )


def test_enrichment_against_brute_force(library):
    lists, sets = library
    got = {(r.drug_slug, r.gene_set, r.term): r for r in enrich.enrich(lists, sets, "drug_slug", 500).collect()}
    members, genes = {}, {}
    for r in sets.collect():
        members.setdefault((r.gene_set, r.term), set()).add(r.symbol)
    for r in lists.collect():
        if r.symbol is not None:
            genes.setdefault(r.drug_slug, set()).add(r.symbol)
    expected = {}
    for e, mine in genes.items():
        for (g, term), theirs in members.items():
            a, k, n = len(mine & theirs), len(theirs), len(mine)
            if a:
                p = sum(math.comb(k, x) * math.comb(500 - k, n - x) for x in range(a, min(n, k) + 1)) / math.comb(500, n)
                expected[e, g, term] = (f"{a}/{k}", p, ";".join(sorted(mine & theirs)))
    assert set(got) == set(expected)
    for e in genes:
        for g in ("big", "small"):
            keys = sorted((k for k in expected if k[:2] == (e, g)), key=lambda k: expected[k][1])
            best = 1.0
            for r in range(len(keys), 0, -1):
                row, (overlap, p, names) = got[keys[r - 1]], expected[keys[r - 1]]
                best = min(best, p * len(keys) / r)
                assert (row.overlap, row.genes) == (overlap, names)
                assert row.p_value == pytest.approx(p, rel=1e-8)
                assert row.adj_p == pytest.approx(best, rel=1e-8)
                if row.odds_ratio is not None:
                    assert row.combined_score == pytest.approx(-math.log(p) * row.odds_ratio, rel=1e-7, abs=1e-9)
    assert got["b", "small", "repeat"].odds_ratio is None  # every member is hit


def test_plot_terms_falls_back_to_the_full_table(spark):
    rows = [("a", "x", f"t{i}", p) for i, p in enumerate([0.001, 0.04, 0.05, 0.2])] + [("a", "y", f"t{i}", 0.5) for i in range(12)] + [("a", "z", "t", 0.0)]
    df = spark.createDataFrame(rows, "drug_slug string, gene_set string, term string, adj_p double")
    got = enrich.plot_terms(df, "drug_slug").collect()
    assert sorted(r.term for r in got if r.gene_set == "x") == ["t0", "t1"]
    assert sorted(r.term for r in got if r.gene_set == "y") == sorted(f"t{i}" for i in range(12))[:10]
    assert [r.score for r in got if r.gene_set == "z"] == pytest.approx([307.6526555685888])
    assert enrich.significant(df).count() == 3


def test_interpretation_plan(spark, library):
    _, sets = library
    coefs = spark.createDataFrame([("a", f"G{i} ({i})", (-1.0) ** i * (i % 9)) for i in range(60)], "drug_slug string, feature string, coefficient double")
    every = interpretation.enrich_top_features(coefs, sets, "drug_slug", background=500)
    top = interpretation.enrich_top_features(coefs, sets, "drug_slug", top_n=10, background=500)
    assert every.count() >= top.count() > 0
