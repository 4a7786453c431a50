"""Ingested sites as Parquet: what an index does for compressed text.

One folder a group and contig, rows in order of position, so a region read opens one contig's files and
skips row groups by the statistics of pos. Runs over the same data again need no genotype parsing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_sites(sites: DataFrame, path: str, mode: str = "error") -> None:
    """Kept sites; ranges of positions are written in parallel."""
    ranges = sites.repartitionByRange("grp", "contig", "pos").sortWithinPartitions("grp", "contig", "pos")
    ranges.withColumn("part", F.concat_ws(":", F.lit("g"), "grp")).write.mode(mode).partitionBy("part", "contig").parquet(path)


def read_sites(spark: SparkSession, path: str, regions: list[tuple[str, int, int, str]] | None = None) -> DataFrame:
    """Stored sites, all or those inside any of the regions; contigs prune folders, positions row groups."""
    sites = spark.read.parquet(path).drop("part").withColumn("contig", F.col("contig").cast("string"))
    if regions is not None:
        inside = [(F.col("contig") == c) & F.col("pos").between(a, b) for c, a, b, _ in regions]
        sites = sites.filter(reduce(lambda x, y: x | y, inside, F.lit(False)))
    return sites
