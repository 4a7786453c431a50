"""Second-stage summaries of bins and histograms: means, quantiles, merged tables, coarse curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Edges of the coarse windows in bp.
WINDOW_EDGES = (0, 10, 50, 100, 200, 300, 600)


def histogram_as_bins(hist: DataFrame) -> DataFrame:
    """Bins (pop, dist, n, sum_rr, sum_d) of a value histogram (pop, dist, value, n_rr[, n_d]): sums are of
    value times count."""
    has_d = "n_d" in hist.columns
    sum_d = F.sum(F.col("value") * F.col("n_d")) if has_d else F.lit(None).cast("double")
    return hist.groupBy("pop", "dist").agg(F.sum("n_rr").alias("n"), F.sum(F.col("value") * F.col("n_rr")).alias("sum_rr"), sum_d.alias("sum_d"))


def mean_bins(bins: DataFrame, short: int = 10, long: int = 100, at: int = 100) -> DataFrame:
    """(pop, is_long, bin_end, n, sum_rr, mean_rr, sum_d, mean_d) of bins (pop, dist, n, sum_rr, sum_d), summed
    over all files of a population. Distances below `at` go to bins of `short`, others of `long`; a bin is
    named by its end. D' means are over rows that have D'."""
    near = F.col("dist") < at
    width = F.when(near, short).otherwise(long)
    out = bins.groupBy("pop", (~near).alias("is_long"), ((F.floor(F.col("dist") / width) + 1) * width).alias("bin_end")).agg(
        F.sum("n").alias("n"), F.sum("sum_rr").alias("sum_rr"), F.sum("sum_d").alias("sum_d"), F.sum(F.when(F.col("sum_d").isNotNull(), F.col("n"))).alias("n_d")
    )
    return out.select("pop", "is_long", "bin_end", "n", "sum_rr", (F.col("sum_rr") / F.col("n")).alias("mean_rr"), "sum_d", F.try_divide("sum_d", "n_d").alias("mean_d"))


def quantile_bins(hist: DataFrame, share: float = 0.5, short: int = 10, long: int = 100, at: int = 100, count: str = "n_rr") -> DataFrame:
    """(pop, is_long, bin_start, value): the least value whose cumulative count is at least the truncated
    share of the bin's count. hist: (pop, dist, value, <count>). The bin of distance d is that of d - 0.1."""
    near = F.col("dist") < at
    width = F.when(near, short).otherwise(long)
    k = F.expr("cast((dist - 0.1D) / w as bigint)")
    binned = hist.filter(F.col(count) > 0).withColumn("w", width).groupBy("pop", (~near).alias("is_long"), (k * F.col("w")).alias("bin_start"), "value").agg(F.sum(count).alias("n"))
    by = Window.partitionBy("pop", "is_long", "bin_start")
    seen = binned.withColumns({
        "seen": F.sum("n").over(by.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)),
        "cut": F.floor(F.sum("n").over(by) * F.lit(share)),
    })
    return seen.filter("seen >= cut").groupBy("pop", "is_long", "bin_start").agg(F.min("value").alias("value"))


def merged_values(hist: DataFrame) -> DataFrame:
    """(pop, dist, value, n_rr[, n_d]) added up over a population's files."""
    counts = [c for c in ("n_rr", "n_d") if c in hist.columns]
    return hist.groupBy("pop", "dist", "value").agg(*[F.sum(c).alias(c) for c in counts])


def check_sizes(sizes: list[int]) -> int:
    """Files that are merged have to come from equally many haplotypes."""
    if len(set(sizes)) > 1:
        raise ValueError(f"files of different sample sizes: {sorted(set(sizes))}")
    return sizes[0]


def axis_range(bins: DataFrame, max_kb: float | None = None) -> DataFrame:
    """(pop, max_kb, y_top): whole kb of the largest distance unless given, and the largest mean, 1 above .96."""
    kb = F.lit(max_kb) if max_kb is not None else F.floor(F.max("dist") / 1000)
    top = F.max(F.col("sum_rr") / F.col("n"))
    return bins.groupBy("pop").agg(kb.alias("max_kb"), F.when(top > 0.96, 1.0).otherwise(top).alias("y_top"))


def coarse_curve(bins: DataFrame, width: int = 10_000) -> DataFrame:
    """(pop, window, n, mean_rr): pair-weighted means in windows of equal width."""
    out = bins.groupBy("pop", F.floor(F.col("dist") / width).alias("window")).agg(F.sum("n").alias("n"), F.sum("sum_rr").alias("s"))
    return out.select("pop", "window", "n", (F.col("s") / F.col("n")).alias("mean_rr"))


def window_curve(bins: DataFrame, edges: tuple[int, ...] = WINDOW_EDGES) -> DataFrame:
    """(pop, window, n, mean_rr) in windows (edge, next edge]; distances beyond the last are left out."""
    window = F.lit(None).cast("int")
    for k in reversed(range(len(edges) - 1)):
        window = F.when((F.col("dist") > edges[k]) & (F.col("dist") <= edges[k + 1]), k).otherwise(window)
    out = bins.withColumn("window", window).filter("window IS NOT NULL").groupBy("pop", "window").agg(F.sum("n").alias("n"), F.sum("sum_rr").alias("s"))
    return out.select("pop", "window", "n", (F.col("s") / F.col("n")).alias("mean_rr"))
