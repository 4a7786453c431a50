"""The library's operators as queries over the given tables, with DuckDB SQL for the same rows.

Each query takes (spark, sf_dir). Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LdConfig
from ..operators import accuracy, aggregates, blocks, ehh, hw, pairs, rebin, regions, sites
from ..session import ship
from ..sources import mappings

MAX_DIST, MAF = 20_000, 0.05
CFG = LdConfig(maf=MAF)
#: A fixed rate for the curve that SQL can follow.
FIXED_C = 0.0002
REGIONS = [("e0", 1000, 40_000, "e0:1000-40000"), ("e0", 20_000, 30_000, "e0:20000-30000"), ("e1", 1, regions.OPEN_END, "e1")]
CORE = ("e0", 30_000)


def _emb(spark, sf, cfg=CFG) -> DataFrame:
    return sites.build_sites(mappings.emb_calls(spark, sf), cfg, mappings.EMB_SAMPLES, phased=True)


def _lim(spark, sf, cfg=CFG) -> DataFrame:
    return sites.build_sites(mappings.li_calls(spark, sf, more_missing=True), cfg, mappings.LI_SAMPLES, phased=False)


def _emb_pairs(spark, sf, out_type) -> DataFrame:
    return pairs.pair_values(pairs.pair_tables(_emb(spark, sf), MAX_DIST, 64), out_type)


def _lim_pairs(spark, sf, out_type) -> DataFrame:
    return pairs.pair_values(pairs.pair_tables(_lim(spark, sf), MAX_DIST, 40), out_type)


def _r(c, name=None):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name) if name else F.round(c, 6)


def _bins(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "dist", F.col("n").cast("long").alias("n"), _r("mean_rr", "mean_rr"), _r("sum_rr", "sum_rr"), _r("mean_d", "mean_d"), _r("sum_d", "sum_d"))


def _pop_bins(spark, sf) -> DataFrame:
    """Two populations: contig e0 and the others."""
    s = _emb(spark, sf).withColumn("grp", F.when(F.col("contig") == "e0", "a").otherwise("b"))
    return aggregates.decay(s, 2, MAX_DIST, 64).withColumnRenamed("grp", "pop")


def _hist(spark, sf, out_type=4) -> DataFrame:
    h = aggregates.value_histogram(_emb_pairs(spark, sf, out_type), out_type, MAX_DIST)
    return h.withColumn("value", F.col("bucket") / 100).withColumnRenamed("grp", "pop")


# --- queries -----------------------------------------------------------------------------------------


def ld_decay_r2(spark: SparkSession, sf: str) -> DataFrame:
    return _bins(aggregates.decay(_emb(spark, sf), 1, MAX_DIST, 64))


def ld_decay_r2_missing(spark, sf):
    return _bins(aggregates.decay(_lim(spark, sf), 1, MAX_DIST, 40))


def ld_decay_blocks(spark, sf):
    return _bins(blocks.decay_by_blocks(_lim(spark, sf), 1, MAX_DIST))


def ld_decay_d_prime(spark, sf):
    return _bins(aggregates.decay(_emb(spark, sf), 2, MAX_DIST, 64))


def ld_decay_type3(spark, sf):
    return _bins(aggregates.decay(_emb(spark, sf), 3, MAX_DIST, 64))


def ld_decay_type7(spark, sf):
    return _bins(aggregates.decay(_emb(spark, sf), 7, MAX_DIST, 64))


def pair_table(spark, sf):
    return pairs.pair_tables(_lim(spark, sf), MAX_DIST, 40).drop("grp")


def pair_r2(spark, sf):
    return _emb_pairs(spark, sf, 3).select("contig", "p1", "p2", "dist", _r("rr", "rr"))


def pair_dprime(spark, sf):
    return _emb_pairs(spark, sf, 6).select("contig", "p1", "p2", "dist", _r("d", "d"), _r("rr", "rr"))


def pair_lod(spark, sf):
    return _emb_pairs(spark, sf, 7).select("contig", "p1", "p2", "dist", _r("d", "d"), _r("lod", "lod"), _r("rr", "rr"))


def pair_ci(spark, sf):
    return _lim_pairs(spark, sf, 8).select("contig", "p1", "p2", "low", "high")


def hist_r2(spark, sf):
    h = aggregates.value_histogram(_lim_pairs(spark, sf, 5), 5, MAX_DIST)
    return h.select("dist", "bucket", F.col("n_rr").cast("long").alias("n_rr"))


def hist_r2_dprime(spark, sf):
    h = aggregates.value_histogram(_lim_pairs(spark, sf, 4), 4, MAX_DIST)
    return h.select("dist", "bucket", F.col("n_rr").cast("long").alias("n_rr"), F.col("n_d").cast("long").alias("n_d"))


def ot0_header_only(spark, sf):
    return _bins(aggregates.decay(_emb(spark, sf), 0, MAX_DIST, 64))


def _stats(spark, sf, mode="vcf", cfg=CFG):
    return sites.site_stats(mappings.li_calls(spark, sf, more_missing=True), cfg, mode)


def site_counts(spark, sf):
    s = _stats(spark, sf)
    return s.select("contig", "pos", F.col("n_samples").cast("long").alias("n_samples"), F.col("n_miss").cast("long").alias("n_miss"), F.col("n_het").cast("long").alias("n_het"),
                    F.col("n_alleles").cast("int").alias("n_alleles"), "best", "sed", F.col("n_best").cast("long").alias("n_best"), F.col("n_sed").cast("long").alias("n_sed"), _r("maf", "maf"))


def site_filter_reasons(spark, sf):
    s = _stats(spark, sf, cfg=LdConfig(maf=0.35, miss=0.12, het=0.5))
    return aggregates.skip_counts(s).select("reason", F.col("n").cast("long").alias("n"))


def geno_maf_2n(spark, sf):
    s = _stats(spark, sf, "genotype_all", LdConfig(maf=0.35, miss=0.12, het=0.5))
    return s.select("contig", "pos", _r("maf", "maf"), F.coalesce("reason", F.lit("kept")).alias("reason"))


def haplotype_planes(spark, sf):
    s = _lim(spark, sf)
    count = lambda c: F.aggregate(F.transform(c, lambda w: F.bit_count(w).cast("long")), F.lit(0).cast("long"), lambda a, v: a + v)
    return s.select("contig", "pos", F.col("minor_count").cast("int").alias("minor_count"), count("miss").alias("n_missing"), "has_missing")


def site_dedupe_keep_first(spark, sf):
    s = _emb(spark, sf)
    twice = s.withColumns({"pos": F.floor(F.col("pos") / 500) * 500})
    return sites.keep_first(twice).select("contig", "pos", "seq", F.col("minor_count").cast("int").alias("minor_count"))


def union_merge_sites(spark, sf):
    emb = _emb(spark, sf).withColumn("contig", F.lit("x"))
    a = emb.filter("seq % 3 <> 0")
    b = emb.filter("seq % 2 = 0").withColumn("minor_count", F.col("minor_count") + 1000)
    return sites.union_inputs(a, b).select("pos", "input_rank", F.col("minor_count").cast("int").alias("minor_count"))


def decay_by_population(spark, sf):
    """Two groups of samples of the same sites, each filtered on its own."""
    calls = mappings.emb_calls(spark, sf)
    groups = spark.createDataFrame([("first" if i < 16 else "second", i, i % 16) for i in range(32)], "grp string, sample_idx int, new_idx int")
    s = sites.build_sites(sites.by_group(calls, groups), CFG, 16, phased=True)
    return _bins(aggregates.decay(s, 1, MAX_DIST, 32), "grp")


def region_decay(spark, sf):
    s = regions.assign(_emb(spark, sf), regions.region_frame(spark, REGIONS))
    p = pairs.pair_values(pairs.pair_tables(s, MAX_DIST, 64), 1)
    return p.groupBy("contig").agg(F.count("*").alias("n"), _r(F.sum("rr"), "sum_rr"))


def region_overlap_rule(spark, sf):
    s = regions.assign(_emb(spark, sf), regions.region_frame(spark, REGIONS))
    return s.select(F.col("contig").alias("label"), "pos")


def plink_encode(spark, sf):
    """Unphased coding: a heterozygote is (0, 1) whatever the order of its alleles."""
    calls = mappings.li_calls(spark, sf)
    values = sites.encode(calls, sites.site_stats(calls, CFG), phased=False)
    return values.groupBy("contig", "pos").agg(*[F.count_if((F.col("va") == a) & (F.col("vb") == b)).cast("long").alias(f"n{a}{b}") for a, b in ((0, 0), (0, 1), (1, 1), (2, 2))])


def mean_bin(spark, sf):
    out = rebin.mean_bins(_pop_bins(spark, sf), 500, 2000, 5000)
    return out.select("pop", "is_long", F.col("bin_end").cast("long").alias("bin_end"), F.col("n").cast("long").alias("n"), _r("mean_rr", "mean_rr"), _r("mean_d", "mean_d"))


def median_bin(spark, sf):
    out = rebin.quantile_bins(_hist(spark, sf), 0.5, 500, 2000, 5000)
    return out.select("is_long", F.col("bin_start").cast("long").alias("bin_start"), _r("value", "value"))


def percentile_bin(spark, sf):
    out = rebin.quantile_bins(_hist(spark, sf), 0.9, 500, 2000, 5000, "n_d")
    return out.select("is_long", F.col("bin_start").cast("long").alias("bin_start"), _r("value", "value"))


def merged_value_table(spark, sf):
    h = _hist(spark, sf)
    twice = rebin.merged_values(h.unionByName(h.filter("bucket < 50")))
    return twice.select("dist", _r("value", "value"), F.col("n_rr").cast("long").alias("n_rr"), F.col("n_d").cast("long").alias("n_d"))


def histogram_means(spark, sf):
    out = rebin.mean_bins(rebin.histogram_as_bins(_hist(spark, sf)), 500, 2000, 5000)
    return out.select("is_long", F.col("bin_end").cast("long").alias("bin_end"), F.col("n").cast("long").alias("n"), _r("mean_rr", "mean_rr"), _r("mean_d", "mean_d"))


def axis_ranges(spark, sf):
    return rebin.axis_range(_pop_bins(spark, sf)).select("pop", F.col("max_kb").cast("long").alias("max_kb"), _r("y_top", "y_top"))


def coarse_curve_10kb(spark, sf):
    out = rebin.coarse_curve(_pop_bins(spark, sf))
    return out.select("pop", F.col("window").cast("long").alias("window"), F.col("n").cast("long").alias("n"), _r("mean_rr", "mean_rr"))


def window_curve(spark, sf):
    out = rebin.window_curve(_pop_bins(spark, sf))
    return out.select("pop", F.col("window").cast("int").alias("window"), F.col("n").cast("long").alias("n"), _r("mean_rr", "mean_rr"))


def merged_bins(spark, sf):
    s = _emb(spark, sf)
    parts = [aggregates.decay(s.filter(F.col("contig") == c), 1, MAX_DIST, 64) for c in ("e0", "e1", "e2")]
    return _bins(aggregates.merge_bins(*parts))


def _two_encodings(spark, sf):
    """Pairs of the phased sites, and of the same calls taken as unphased."""
    calls = mappings.emb_calls(spark, sf)
    unphased = sites.build_sites(calls, CFG, mappings.EMB_SAMPLES, phased=False)
    other = pairs.pair_values(pairs.pair_tables(unphased, MAX_DIST, 64), 3)
    return accuracy.joined_pairs(_emb_pairs(spark, sf, 3), other)


def pair_compare(spark, sf):
    both = _two_encodings(spark, sf).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})
    out = accuracy.agreement(both, 0.01)
    return out.select(F.col("n").cast("long").alias("n"), *[_r(c, c) for c in ("pearson", "spearman", "mean_abs", "max_abs", "within")], F.col("identical").cast("long").alias("identical"))


def top_pairs(spark, sf):
    both = _two_encodings(spark, sf).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})
    return accuracy.top_differences(both).select("contig", "p1", "p2", _r("x", "x"), _r("y", "y"), _r("diff", "diff"))


def minor_count_blocks(spark, sf):
    p = pairs.pair_values(pairs.pair_tables(_emb(spark, sf), MAX_DIST, 64), 3)
    both = p.select("contig", "p1", "p2", F.least(F.col("n11") + F.col("n10"), F.col("n11") + F.col("n01")).alias("least"), F.col("rr").alias("x"), F.round("rr", 2).alias("y"))
    out = accuracy.count_blocks(both, F.col("least").cast("double"))
    return out.select("block", F.col("n").cast("long").alias("n"), _r("mean_abs", "mean_abs"), _r("max_abs", "max_abs"))


def systematic_sample(spark, sf):
    return _emb(spark, sf).filter(accuracy.systematic(F.col("seq"), 3, 10)).select("contig", "pos")


def every_nth_site(spark, sf):
    return _emb(spark, sf).filter(accuracy.nth_site(F.col("seq"), 7)).select("contig", "pos")


def ehh_decay(spark, sf):
    out = ehh.ehh_decay(_emb(spark, sf), *CORE, 5_000)
    return out.select("contig", "pos", "dist", *[_r(c, c) for c in ("ehh_all", "ehh_0", "ehh_1")])


def hw_fixed_curve(spark, sf):
    b = aggregates.decay(_emb(spark, sf), 1, MAX_DIST, 64)
    return hw.fitted_curve(b, FIXED_C, 64).select("dist", _r("fitted", "fitted"))


def hw_fit_curve(spark, sf):
    b = aggregates.decay(_emb(spark, sf), 1, MAX_DIST, 64).select("dist", F.col("mean_rr").alias("value"), F.col("n").alias("weight"))
    c = hw.fit(b, 64)
    return hw.fitted_curve(b, c, 64).select("dist", _r("fitted", "fitted"))


def run_summary(spark, sf):
    """Fixed run times through the summary of repeated runs."""
    times = spark.createDataFrame([(t, 10.0 / t + r) for t in (1, 2, 4) for r in (0.0, 0.5, 1.0)], "threads int, seconds double")
    return accuracy.run_summary(times).select("threads", *[_r(c, c) for c in ("mean", "sd", "speed_up", "efficiency")])


QUERIES = (
    ld_decay_r2, ld_decay_r2_missing, ld_decay_blocks, ld_decay_d_prime, ld_decay_type3, ld_decay_type7, pair_table, pair_r2, pair_dprime, pair_lod, pair_ci, hist_r2,
    hist_r2_dprime, ot0_header_only, site_counts, site_filter_reasons, geno_maf_2n, haplotype_planes, site_dedupe_keep_first, union_merge_sites, decay_by_population,
    region_decay, region_overlap_rule, plink_encode, mean_bin, median_bin, percentile_bin, merged_value_table, histogram_means, axis_ranges, coarse_curve_10kb, window_curve,
    merged_bins, pair_compare, top_pairs, minor_count_blocks, systematic_sample, every_nth_site, ehh_decay, hw_fixed_curve, hw_fit_curve, run_summary,
)


def queries() -> dict:
    def shipped(query):
        return lambda spark, sf_dir: query(ship(spark), sf_dir)

    from .file_queries import QUERIES as of_files

    return {q.__name__: shipped(q) for q in (*QUERIES, *of_files)}


def oracle_sql() -> dict[str, str]:
    from .file_queries import ORACLES
    from .oracles import SQL

    return SQL | ORACLES
