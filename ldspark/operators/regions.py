"""Regions: parsing and membership."""

from __future__ import annotations

import gzip
import os
import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The end of a region that has none.
OPEN_END = (1 << 62) - 1
SCHEMA = "contig string, start long, end long, label string"


def parse_bed(path: str) -> list[tuple[str, int, int, str]]:
    """Half-open 0-based lines as 1-based inclusive regions; bad lines are skipped with a warning."""
    out = []
    with (gzip.open(path, "rt") if path.endswith(".gz") else open(path)) as f:
        for line in f:
            cols = line.split()
            if not cols or line.startswith(("#", "track", "browser")):
                continue
            try:
                contig, a, b = cols[0], int(cols[1]) + 1, int(cols[2])
                if a < 1 or b < a:
                    raise ValueError
            except (IndexError, ValueError):
                warnings.warn(f"skipped a bad BED line: {line.rstrip()}", stacklevel=2)
                continue
            out.append((contig, a, b, f"{contig}:{a}-{b}"))
    return out


def parse_token(token: str) -> tuple[str, int, int, str]:
    """chr, chr:pos or chr:first-last."""
    contig, colon, span = token.rpartition(":")
    if not colon:
        return token, 1, OPEN_END, token
    first, dash, last = span.partition("-")
    try:
        a = int(first.replace(",", ""))
        b = int(last.replace(",", "")) if dash else a
    except ValueError:
        raise ValueError(f"not a region: {token}") from None
    if a < 1 or b < a:
        raise ValueError(f"not a region: {token}")
    return contig, a, b, f"{contig}:{a}-{b}"


def load_regions(spec: str) -> list[tuple[str, int, int, str]]:
    """An existing file is BED, anything else a comma list. Sorted by label, repeats dropped."""
    found = parse_bed(spec) if os.path.exists(spec) else [parse_token(t.strip()) for t in spec.split(",") if t.strip()]
    if not found:
        raise ValueError(f"no region in {spec}")
    return sorted(set(found), key=lambda r: (r[3], r[1], r[2]))


def region_frame(spark: SparkSession, regions: list[tuple[str, int, int, str]]) -> DataFrame:
    return spark.createDataFrame(regions, SCHEMA)


#: Up to so many regions are broadcast; beyond, they are shuffled by contig.
BROADCAST_REGIONS = 1_000_000


def assign(sites: DataFrame, regions: DataFrame, strict_compat: bool = True) -> DataFrame:
    """sites inside a region, with the region's label as contig.

    strict_compat: only the region with the largest start at or before the position is looked at, so an
    enclosing region does not take over behind the end of an inner one; then a region reaches up to the next
    one's start at most and a site meets one. Without it a site goes to every region that holds it."""
    ends = F.col("end")
    if strict_compat:
        following = F.lead("start").over(Window.partitionBy("contig").orderBy("start", "end", "label"))
        regions = regions.withColumn("next", following)
        ends = F.least(F.col("end"), F.col("next") - 1)  # least leaves nulls out
    r = regions.select(F.col("contig").alias("__c"), F.col("start").alias("__s"), ends.alias("__e"), F.col("label").alias("__l"))
    r = F.broadcast(r) if regions.count() <= BROADCAST_REGIONS else r
    joined = sites.join(r, (F.col("contig") == F.col("__c")) & F.col("pos").between(F.col("__s"), F.col("__e")))
    return joined.withColumn("contig", F.col("__l")).select(*sites.columns)
