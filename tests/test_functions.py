import math

import pytest
from pyspark.sql import functions as F

from dosewise.functions import numbers, stats, text


def apply(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", fn(F.col("v"))).orderBy("i").collect()]


def test_clean_id(spark):
    raw = ["906792", "906792.0", " 906792 ", "\t906792 ", "", "nan", "None", "NA", "<NA>", "na", ".0", None, " 1.0.0 ", "\x1f7"]
    assert apply(spark, raw, text.clean_id) == ["906792"] * 4 + [None] * 5 + ["na", "", None, "1.0", "7"]


def test_usable_id_drops_the_empty_rest_of_dot_zero(spark):
    assert apply(spark, [".0", "1.0"], lambda c: text.usable_id(text.clean_id(c))) == [False, True]


def test_to_number(spark):
    raw = ["1e3", " 2.5 ", "+3", "inf", "-Infinity", "NaN", "bad", "1d", "1f", "1_000", "", None, ".5", "5.", "0x1p3", "-.25E+1"]
    got = apply(spark, raw, numbers.to_number)
    assert got == [1000.0, 2.5, 3.0, math.inf, -math.inf] + [None] * 7 + [0.5, 5.0, None, -2.5]


def test_to_number_of_doubles_turns_nan_into_null(spark):
    assert apply(spark, [1.5, float("nan"), None, 1e-7], numbers.to_number, "double") == [1.5, None, None, 1e-7]


def test_names(spark):
    assert apply(spark, ["Cell line_name", "__", "LN-IC50 (µM)", "Größe²"], text.normalise_name) == [
        "cell line name",
        "",
        "ln ic50 µm",
        "größe²",
    ]
    assert apply(spark, ["Nutlin-3a (-)", "  ", "(-)", "Bleomycin (50 uM)"], text.slug) == ["nutlin_3a", "", "", "bleomycin_50_um"]
    assert apply(spark, ["Nutlin-3a (-)", "  ", "(-)"], text.file_slug) == ["nutlin_3a", "drug", "drug"]
    assert apply(spark, [" a b c\t"], text.join_key) == ["ABC"]


def test_gene_symbol_and_feature_pattern(spark):
    names = ["KRTAP6-1 (337966)", "(1)", "HLA.A (3105)", None, "plain"]
    assert apply(spark, names, text.gene_symbol) == ["KRTAP6-1", None, "HLA", None, "plain"]
    assert apply(spark, names, text.looks_like_feature) == [True, True, True, None, False]


def test_missing_words(spark):
    assert apply(spark, ["", "NA", "null", "na", "x", None], text.decode_missing) == [None, None, None, "na", "x", None]


def test_minus_log10_lifts_zero(spark):
    got = apply(spark, [0.0, 1.0, 0.001], numbers.minus_log10, "double")
    assert got == pytest.approx([307.6526555685888, 0.0, 3.0])


def test_alpha_grid_ends(spark):
    got = apply(spark, [0, 49, 30], numbers.alpha_at, "int")
    assert got == pytest.approx([1e-3, 10.0, 0.2811768697974228])


def test_log_factorial(spark):
    ns = [0, 1, 2, 19, 20, 21, 22, 50, 1000, 20000, 10**9]
    assert apply(spark, ns, stats.log_factorial, "bigint") == pytest.approx([math.lgamma(n + 1) for n in ns], rel=1e-13, abs=1e-12)


def exact_tail(a, n, k, total):
    return sum(math.comb(k, x) * math.comb(total - k, n - x) for x in range(a, min(n, k) + 1)) / math.comb(total, n)


def test_hypergeometric_tail_equals_exact_integers(spark):
    cases = [(5, 250, 95, 20000), (1, 250, 1, 20000), (3, 10, 12, 30), (1, 1000, 500, 2000), (10, 10, 10, 20), (2, 25, 28, 30), (1, 3000, 3000, 6000)]
    df = spark.createDataFrame(cases, "a bigint, n bigint, k bigint, t bigint")
    got = [
        (r.a, r.n, r.k, r.t, r.p)
        for r in df.select("*", stats.hypergeometric_tail(F.col("a"), F.col("n"), F.col("k"), F.col("t")).alias("p")).collect()
    ]
    for a, n, k, t, p in got:
        assert p == pytest.approx(exact_tail(a, n, k, t), rel=1e-8)


def test_recorded_enrichment_rows(spark):
    # Overlap, set size, p, odds ratio, combined score of published rows: 250 genes, background 20,000.
    rows = [
        (5, 95, 0.0068233018102686, 4.458049886621315, 22.234130555492047),
        (7, 192, 0.0106541484941122, 3.046490935379824, 13.836570604255977),
        (3, 60, 0.0392101184424837, 4.196249733645856, 13.590899416906105),
        (2, 29, 0.0506493570161387, 5.8909796893667865, 17.571783541959874),
        (8, 75, 4.3660683761163095e-06, 9.711607252991245, 119.85723472395466),
    ]
    df = spark.createDataFrame(rows, "a bigint, k bigint, p double, o double, c double")
    n, t = F.lit(250).cast("bigint"), F.lit(20000).cast("bigint")
    p = stats.hypergeometric_tail(F.col("a"), n, F.col("k"), t)
    for r in df.select("*", p.alias("gp"), stats.odds_ratio(F.col("a"), n, F.col("k"), t).alias("go")).collect():
        assert r.gp == pytest.approx(r.p, rel=1e-4)
        assert r.go == pytest.approx(r.o, rel=1e-12)
        assert -math.log(r.p) * r.go == pytest.approx(r.c, rel=1e-12)


def test_odds_ratio_is_null_without_an_outside(spark):
    df = spark.createDataFrame([(3, 3), (2, 3)], "a bigint, k bigint")
    got = df.select(stats.odds_ratio(F.col("a"), F.lit(10), F.col("k"), F.lit(100)).alias("o")).collect()
    assert got[0].o is None and got[1].o is not None
