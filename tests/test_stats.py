import math
import random

import brute
import pytest

from burdenlens.functions import stats


def p_values(spark, rows, table="standard"):
    df = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "i int, sum_case long, n_case long, sum_control long, n_control long",
    )
    found = df.select("i", stats.fisher_greater(table=table).alias("p")).collect()
    return [r["p"] for r in sorted(found, key=lambda r: r["i"])]


# P-values of published rankings: (sum_case, n_case, sum_control, n_control), p.
STORED = [
    ((16, 17, 32, 75), 5.0866737961e-07),
    ((10, 17, 10, 75), 7.9705185493e-05),
    ((3, 17, 0, 75), 5.4148749801e-03),
    ((10, 17, 5, 71), 4.8084979016e-06),
    ((7, 17, 2, 71), 7.4914116206e-05),
]


def test_stored_p_values_use_the_compat_table(spark):
    found = p_values(spark, [r for r, _ in STORED], "compat")
    assert found == pytest.approx([p for _, p in STORED], rel=1e-9)


def test_without_control_carriers_both_tables_agree(spark):
    assert p_values(spark, [(3, 17, 0, 75)])[0] == pytest.approx(5.4148749801e-03, rel=1e-9)


@pytest.mark.parametrize("table", ["standard", "compat"])
def test_every_small_table(spark, table):
    rows = [
        (a, n1, c, n2) for n1 in range(1, 6) for n2 in range(1, 6)
        for a in range(n1 + 1) for c in range(n2 + 1)
    ]
    expected = [brute.fisher(*r, table) for r in rows]
    assert p_values(spark, rows, table) == pytest.approx(expected, rel=1e-11, abs=1e-14)


def test_large_tables(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(120):
        n1, n2, share = rng.randint(50, 2500), rng.randint(50, 2500), rng.random()
        a = min(n1, max(0, int(n1 * share + rng.gauss(0, 15))))
        c = min(n2, max(0, int(n2 * share + rng.gauss(0, 15))))
        rows.append((a, n1, c, n2))
    expected = [brute.fisher(*r) for r in rows]
    assert p_values(spark, rows) == pytest.approx(expected, rel=1e-9, abs=1e-280)


def test_million_samples_in_a_tail(spark):
    # Poisson limit: 40 carriers among many, all of them cases
    found = p_values(spark, [(40, 500_000, 0, 500_000), (0, 500_000, 9, 500_000)])
    assert found[0] == pytest.approx(math.prod((500_000 - i) / (1e6 - i) for i in range(40)), rel=1e-7)
    assert found[1] == 1.0


def test_empty_group_has_no_p_value(spark):
    assert p_values(spark, [(3, 17, 0, 0), (0, 0, 1, 4)]) == [None, None]


def test_t_tail_against_finite_series(spark):
    rows = [
        (float(t), df)
        for df in (1, 2, 3, 5, 10, 33, 145, 605, 5000, 30001)
        for t in (-3, 0, 1e-6, 0.01, 0.5, 1, 1.7, 1.73, 1.74, 1.8, 2, 3, 5, 8)
    ]
    df = spark.createDataFrame(rows, "t double, df long")
    found = df.select(
        "t", "df", stats.t_halved("t", "df").alias("p"), stats.t_greater("t", "df").alias("g")
    ).collect()
    for r in found:
        half = (1 - brute.t_inside(r["t"], r["df"])) / 2
        assert r["p"] == pytest.approx(half, abs=1e-11)
        assert r["g"] == pytest.approx(half if r["t"] >= 0 else 1 - half, abs=1e-11)


def test_terms_of_the_t_tail(spark):
    """Few steps where t is small, at most 60 anywhere, and no more than the tail needs."""
    near, far = stats._fraction_terms("sqrt(y)", "81D * x / (df / 2 * y)"), stats._fraction_terms("sqrt(x)")
    rows = [(float(t), df) for df in (1, 9, 500, 6000, 10**8) for t in (0.01, 0.4, 1.2, 1.74, 1.9, 4.0, 30.0)]
    found = (
        spark.createDataFrame(rows, "t double, df long")
        .selectExpr("t", "df", "df / (df + t * t) AS x", "t * t / (df + t * t) AS y")
        .selectExpr("t", "df", f"IF(x < (df / 2 + 1) / (df / 2 + 2.5D), {near}, {far}) AS n")
        .collect()
    )
    assert all(3 <= r.n <= 60 for r in found)
    assert all(r.n <= 12 for r in found if r.df >= 500 and r.t <= 1.2)


# Halved t-test p-values of a published ranking, from sums and sums of squares.
def test_stored_t_test(spark):
    rows = [(32, 1, 1, 115, 1, 1, 0.16667901874253), (32, 0, 0, 115, 4, 8, 0.22800432742152)]
    df = spark.createDataFrame(
        rows,
        "n_case long, sum_case long, sumsq_case long, n_control long, sum_control long,"
        " sumsq_control long, p double",
    )
    found = df.withColumn("t", stats.pooled_t()).select(
        "p", stats.t_halved("t", "n_case + n_control - 2").alias("found")
    )
    for r in found.collect():
        assert r["found"] == pytest.approx(r["p"], rel=1e-12)


def test_no_variance_no_t(spark):
    df = spark.sql(
        "SELECT 3L AS n_case, 3L AS sum_case, 3L AS sumsq_case, 2L AS n_control,"
        " 2L AS sum_control, 2L AS sumsq_control"
    )
    assert df.select(stats.pooled_t()).head()[0] is None
