import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ldspark.functions import ldmath, sql
from ldspark.operators import hw


def one(f, *n):
    return f(*[np.array([x]) for x in n], ldmath.arrays)


def test_hand_made_tables():
    assert one(ldmath.r2, 25, 25, 25, 25)[0] == pytest.approx(0)
    assert one(ldmath.r2, 60, 0, 0, 40)[0] == pytest.approx(1)
    assert one(ldmath.r2, 0, 0, 0, 50)[0] == pytest.approx(0.25)
    d, r = one(ldmath.dprime_r2, 60, 0, 0, 40)
    assert d[0] == pytest.approx(1) and r[0] == pytest.approx(1)
    d, _ = one(ldmath.dprime_r2, 25, 25, 25, 25)
    assert d[0] == pytest.approx(0)
    assert not ldmath.counted(np.array([0]), np.array([0]), np.array([5]))[0]


tables = st.lists(st.tuples(*[st.integers(0, 60)] * 4), min_size=1, max_size=40)


@settings(max_examples=20, deadline=None)
@given(tables)
def test_three_formulas_agree(rows):
    n = [np.array(c) for c in zip(*rows, strict=True)]
    ok = (n[3] + n[2] > 0) & (n[3] + n[1] > 0) & (n[0] + n[1] > 0) & (n[0] + n[2] > 0)
    n = [c[ok] for c in n]
    if len(n[0]):
        a, (d, b), (_, c, lod) = ldmath.r2(*n, ldmath.arrays), ldmath.dprime_r2(*n, ldmath.arrays), ldmath.dprime_r2_lod(*n, ldmath.arrays)
        assert np.allclose(a, b, atol=1e-6) and np.allclose(a, c, atol=1e-4)
        assert (d > -1e-9).all() and (d < 1 + 1e-6).all() and (lod > -1e-6).all()


def test_columns_and_arrays_agree(spark):
    rng = np.random.default_rng(1)
    n = rng.integers(0, 30, (200, 4))
    n = n[(n[:, 3] + n[:, 2] > 0) & (n[:, 3] + n[:, 1] > 0)]
    df = spark.createDataFrame([tuple(map(int, r)) for r in n], "n00 long, n01 long, n10 long, n11 long")
    cols = [F.col(c) for c in ("n00", "n01", "n10", "n11")]
    d, r = ldmath.dprime_r2(*cols)
    d3, r3, lod = ldmath.dprime_r2_lod(*cols)
    got = df.select(ldmath.r2(*cols).alias("a"), d.alias("d"), r.alias("r"), d3.alias("d3"), r3.alias("r3"), lod.alias("lod")).toPandas().to_numpy(float)
    x = list(n.T)
    want = np.array([ldmath.r2(*x, ldmath.arrays), *ldmath.dprime_r2(*x, ldmath.arrays), *ldmath.dprime_r2_lod(*x, ldmath.arrays)]).T
    assert np.allclose(got, want, equal_nan=True)


def test_sql_functions(spark):
    assert sql.register(spark) == ["ld_r2", "ld_dprime", "ld_lod"]
    row = spark.sql("SELECT ld_r2(60, 0, 0, 40) AS a, ld_dprime(60, 0, 0, 40) AS b, ld_lod(25, 25, 25, 25) AS c, ld_r2(5, 5, 0, 0) AS d").collect()[0]
    assert row["a"] == pytest.approx(1) and row["b"] == pytest.approx(1) and row["c"] == pytest.approx(0, abs=1e-9) and row["d"] is None


def test_likelihood_interval_bounds():
    low, high = ldmath.likelihood_interval(*[np.array(c) for c in ([60, 25, 10], [0, 25, 3], [0, 25, 3], [40, 25, 10])])
    assert low[0] > 80 and high[0] == 100 and (low <= high).all() and (low >= -1).all()


def test_fit_finds_the_rate(spark):
    n, c = 64, 0.003
    df = spark.range(1, 400).select((F.col("id") * 25).alias("dist"), F.lit(3).alias("weight"))
    df = df.withColumn("value", hw.expected(c, F.col("dist"), n))
    assert hw.fit(df, n) == pytest.approx(c, rel=1e-5)
    with pytest.raises(ValueError):
        hw.fit(df, n, limit=100)
