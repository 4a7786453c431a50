"""Comparing two tables of pair values, and sampling of sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def joined_pairs(a: DataFrame, b: DataFrame, value: str = "rr") -> DataFrame:
    """(contig, p1, p2, x, y) of the pairs in both; the order of a pair's positions does not matter."""
    side = lambda t, name: t.select("contig", F.least("p1", "p2").alias("p1"), F.greatest("p1", "p2").alias("p2"), F.col(value).alias(name))
    return side(a, "x").join(side(b, "y"), ["contig", "p1", "p2"])


def agreement(pairs: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """One row: n, pearson, spearman, mean_abs, max_abs, within, identical. Ranks break ties by position, so
    they come from a total order; equal-depth ranges rank in parallel."""
    ranked = _ranks(_ranks(pairs, "x", "rx"), "y", "ry")
    far = F.abs(F.col("x") - F.col("y"))
    return ranked.agg(
        F.count("*").alias("n"), F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"), F.avg(far).alias("mean_abs"),
        F.max(far).alias("max_abs"), F.avg((far <= tolerance).cast("double")).alias("within"), F.count_if(far == 0).alias("identical"),
    )


def _ranks(df: DataFrame, by: str, name: str) -> DataFrame:
    """Global ranks without one window over everything: rows are ranked inside ranges of the value (its
    rounded thousandths), and ranges are moved up by the counts below them, a table of bounded size."""
    part = F.floor(F.col(by) * 1000).cast("long")
    df = df.withColumn("__part", part)
    sizes = df.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).drop("__n")
    local = F.row_number().over(Window.partitionBy("__part").orderBy(by, "contig", "p1", "p2"))
    return df.withColumn("__r", local).join(F.broadcast(before), "__part").withColumn(name, (F.col("__r") + F.col("__before")).cast("double")).drop("__part", "__r", "__before")


def top_differences(pairs: DataFrame, n: int = 10) -> DataFrame:
    """The n pairs that differ most."""
    return pairs.withColumn("diff", F.abs(F.col("x") - F.col("y"))).orderBy(F.desc("diff"), "contig", "p1", "p2").limit(n)


def count_blocks(pairs: DataFrame, order: Column, blocks: int = 4) -> DataFrame:
    """(block, n, mean_abs, max_abs): equal-size blocks of the pairs sorted by `order`; the last takes the rest."""
    total = pairs.count()
    size = max(1, total // blocks)
    ranked = _ranks(pairs.withColumn("__o", order), "__o", "__rank")
    far = F.abs(F.col("x") - F.col("y"))
    block = F.least(F.floor((F.col("__rank") - 1) / size), F.lit(blocks - 1)).cast("int")
    return ranked.groupBy(block.alias("block")).agg(F.count("*").alias("n"), F.avg(far).alias("mean_abs"), F.max(far).alias("max_abs"))


def run_summary(times: DataFrame) -> DataFrame:
    """(threads, mean, sd, speed_up, efficiency) of run times (threads, seconds): speed-up is the ratio of
    means to one thread's, efficiency 100 T1 / (T * T_T)."""
    out = times.groupBy("threads").agg(F.avg("seconds").alias("mean"), F.stddev_samp("seconds").alias("sd"))
    one = out.filter("threads = 1").select(F.col("mean").alias("one"))
    base = F.lit(one.collect()[0][0] if one.count() else None).cast("double")
    return out.withColumns({"speed_up": base / F.col("mean"), "efficiency": 100 * base / (F.col("threads") * F.col("mean"))})


def nth_site(index: Column, n: int) -> Column:
    """Every n-th by an index from 0."""
    return index % n == 0


def systematic(index: Column, keep: int, of: int) -> Column:
    """`keep` of each `of`, evenly: index * keep mod of < keep."""
    return (index * keep) % of < keep


def random_subset(sites: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n sites by a seeded hash of their place, which no partitioning changes."""
    return sites.orderBy(F.xxhash64(F.lit(seed), "contig", "pos"), "contig", "pos").limit(n)
