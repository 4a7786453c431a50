import pytest
from pyspark.sql import functions as F

from ldspark.operators import accuracy, aggregates, rebin
from ldspark.plans import catalog
from ldspark.streaming.increments import DecayStream

SF = "/root/testdata/sf0.001"


def test_band_join_is_the_inequality_join(spark):
    from ldspark.operators.pairs import pair_tables

    sites = catalog._emb(spark, SF).persist()
    got = pair_tables(sites, catalog.MAX_DIST, 64).select("contig", "p1", "p2")
    a, b = sites.select("contig", "pos").alias("a"), sites.select("contig", "pos").alias("b")
    want = a.join(b, (F.col("a.contig") == F.col("b.contig")) & (F.col("b.pos") > F.col("a.pos")) & (F.col("b.pos") - F.col("a.pos") <= catalog.MAX_DIST))
    want = want.select("a.contig", F.col("a.pos"), F.col("b.pos"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_empty_sites(spark):
    none = catalog._emb(spark, SF).filter("false")
    assert aggregates.decay(none, 1, 1000, 64).count() == 0


def test_bin_labels(spark):
    bins = spark.createDataFrame([("", d, 1, 1.0, 1.0) for d in (9, 10, 99, 100, 150)], "pop string, dist long, n long, sum_rr double, sum_d double")
    got = {r["bin_end"]: r["n"] for r in rebin.mean_bins(bins).collect()}
    assert got == {10: 1, 20: 1, 100: 1, 200: 2}
    hist = spark.createDataFrame([("", d, 0.1, 1) for d in (9, 10, 99, 100, 150)], "pop string, dist long, value double, n_rr long")
    got = {(r["is_long"], r["bin_start"]) for r in rebin.quantile_bins(hist).collect()}
    assert got == {(False, 0), (False, 90), (True, 0), (True, 100)}
    with pytest.raises(ValueError):
        rebin.check_sizes([4, 6])


def test_histogram_shift(spark):
    v = spark.createDataFrame([("", 5, 0.25), ("", 10, 0.5)], "grp string, dist long, rr double")
    assert [(r["dist"], r["bucket"]) for r in aggregates.value_histogram(v, 5, 10).collect()] == [(6, 25)]
    assert aggregates.value_histogram(v, 5, 10, strict_compat=False).count() == 2


def test_ranks_are_global(spark):
    pairs = spark.createDataFrame([("c", k, k + 1, float((k * 37) % 101) / 50, float((k * 53) % 97) / 50) for k in range(300)], "contig string, p1 long, p2 long, x double, y double")
    ranks = {r["p1"]: r["r"] for r in accuracy._ranks(pairs, "x", "r").collect()}
    rows = sorted(pairs.collect(), key=lambda r: (r["x"], r["contig"], r["p1"], r["p2"]))
    assert [ranks[r["p1"]] for r in rows] == list(range(1, 301))


def test_stream_adds_up(spark, tmp_path):
    sites = catalog._emb(spark, SF).persist()
    src = tmp_path / "src"
    for k in range(3):
        sites.filter(F.col("seq") % 3 == k).coalesce(1).write.mode("append").parquet(str(src))
    s = DecayStream(str(tmp_path / "out"), catalog.MAX_DIST, 1, 64)
    s.start(spark.readStream.schema(sites.schema).option("maxFilesPerTrigger", 1).parquet(str(src))).awaitTermination(120)
    got = {r["dist"]: (r["n"], round(r["sum_rr"], 8)) for r in s.bins(spark).collect()}
    want = {r["dist"]: (r["n"], round(r["sum_rr"], 8)) for r in aggregates.decay(sites, 1, catalog.MAX_DIST, 64).collect()}
    assert got == want


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    q = e.queries()
    assert set(e.oracle_sql()) <= set(q) and all(map(callable, q.values()))


def test_one_pass_packing_is_the_two_pass_one(spark):
    import random

    from ldspark.config import LdConfig
    from ldspark.operators import sites

    r = random.Random(3)
    rows = [("", c, p, p, 0, s, *r.choice([("A", "A"), ("A", "T"), ("T", "A"), ("T", "T"), (".", "A") if p % 7 == 0 else ("A", "A")]), r.random() < 0.06)
            for c in ("x", "y") for p in range(1, 30) for s in range(45)]
    calls = spark.createDataFrame(rows, "grp string, contig string, pos long, seq long, input_rank int, sample_idx int, a string, b string, miss boolean")
    for phased in (True, False):
        one = sites.build_sites(calls, LdConfig(), 45, phased)
        two = sites.pack(sites.encode(calls, sites.site_stats(calls, LdConfig()), phased), 45)
        key = lambda t: sorted((x["contig"], x["pos"], x["minor"], x["miss"], x["minor_count"], x["has_missing"], x["n_hap"]) for x in t.collect())
        assert key(one) == key(two) and len(key(one)) >= 40
