"""Distance bins, value histograms and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairs import pair_tables, pair_values

#: Output types that give a table of pairs beside the bins.
PAIR_TYPES = (3, 6, 7, 8)


def distance_bins(values: DataFrame, out_type: int) -> DataFrame:
    """(grp, dist, n, sum_rr, mean_rr, sum_d, mean_d) of pair_values. D' is given for types 2 and 4; type 3
    gives 0; others null."""
    sum_d = F.sum("d") if out_type in (2, 4) else F.lit(0.0) if out_type == 3 else F.lit(None).cast("double")
    out = values.groupBy("grp", "dist").agg(F.count("*").alias("n"), F.sum("rr").alias("sum_rr"), sum_d.alias("sum_d"))
    return out.select("grp", "dist", "n", "sum_rr", (F.col("sum_rr") / F.col("n")).alias("mean_rr"), "sum_d", (F.col("sum_d") / F.col("n")).alias("mean_d"))


def value_histogram(values: DataFrame, out_type: int, max_dist: int, strict_compat: bool = True) -> DataFrame:
    """(grp, dist, bucket, n_rr[, n_d]) for types 5 and 4: pairs by truncated hundredths of r2 (and D').

    strict_compat: a pair at distance d counts at d + 1 and pairs at the largest distance are left out, as
    the established files have it."""
    slot = lambda c: F.floor(F.col(c) * 100).cast("int")
    if out_type == 5:
        out = values.groupBy("grp", "dist", slot("rr").alias("bucket")).agg(F.count("*").alias("n_rr"))
    else:
        both = values.select("grp", "dist", F.explode(F.array(F.struct(F.lit(True).alias("is_rr"), slot("rr").alias("bucket")), F.struct(F.lit(False).alias("is_rr"), slot("d").alias("bucket")))).alias("v"))
        out = both.groupBy("grp", "dist", "v.bucket").agg(F.count_if("v.is_rr").alias("n_rr"), F.count_if(~F.col("v.is_rr")).alias("n_d"))
    if strict_compat:
        out = out.filter(F.col("dist") < max_dist).withColumn("dist", F.col("dist") + 1)
    return out


def decay(sites: DataFrame, out_type: int, max_dist: int, n_hap: int | None = None) -> DataFrame:
    """Sites to distance bins in one plan; type 0 gives no rows and joins nothing."""
    if out_type == 0:
        return sites.sparkSession.createDataFrame([], "grp string, dist long, n long, sum_rr double, mean_rr double, sum_d double, mean_d double")
    return distance_bins(pair_values(pair_tables(sites, max_dist, n_hap), out_type), out_type)


def skip_counts(stats: DataFrame) -> DataFrame:
    """(grp, reason, n): how many sites each filter took; reason `kept` for the rest."""
    return stats.groupBy("grp", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def merge_bins(*tables: DataFrame) -> DataFrame:
    """Bins of disjoint sets of pairs added up; the same operation merges runs, files and batches."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    out = out.groupBy("grp", "dist").agg(F.sum("n").alias("n"), F.sum("sum_rr").alias("sum_rr"), F.sum("sum_d").alias("sum_d"))
    return out.select("grp", "dist", "n", "sum_rr", (F.col("sum_rr") / F.col("n")).alias("mean_rr"), "sum_d", (F.col("sum_d") / F.col("n")).alias("mean_d"))
