"""The band self-join of sites and the 2x2 tables of its pairs.

sites: (grp, contig, pos, n_hap, minor, miss, minor_count, has_missing), with planes as arrays of 64-bit
words. Positions fall into buckets of the largest distance; a left row looks into its own bucket and the
next, a right row stands in its own only, so each pair meets once in an equi-join with a residual test,
whatever the contig's length. Skewed buckets are left to adaptive execution.

For OutTypes that only need bins nothing is kept a pair: partial sums follow the join in the same stage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ldmath

#: Up to so many words a pair's popcounts are unrolled into generated code; above, folded over arrays.
UNROLLED = 8
_TABLE = ("n00", "n01", "n10", "n11")


def _words(col: str, n: int) -> list[Column]:
    return [F.get(F.col(col), F.lit(k)) for k in range(n)]


def pair_tables(sites: DataFrame, max_dist: int, n_hap: int | None = None, keep: tuple[str, ...] = (), behind: DataFrame | None = None) -> DataFrame:
    """(grp, contig, p1, p2, dist, n00, n01, n10, n11) of all pairs with 0 < dist <= max_dist.

    n_hap: haplotypes if all groups have that many, which lets the popcounts unroll. Missing haplotypes
    are left out pair by pair. No sites give no pairs. keep: site columns to carry as <name>1, <name>2.
    behind: the sites that are second in a pair, if not the same ones."""
    cols = ["pos", "n_hap", "minor", "miss", "minor_count", "has_missing", *keep]
    bucket = F.floor(F.col("pos") / max_dist).cast("long")
    left = sites.select("grp", "contig", *[F.col(c).alias(f"l_{c}") for c in cols], F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    # both sides explode, so that nothing is pushed into only one of them and the sites are made once
    right = (sites if behind is None else behind).select("grp", "contig", *[F.col(c).alias(f"r_{c}") for c in cols], F.explode(F.array(bucket)).alias("bucket"))
    dist = F.col("r_pos") - F.col("l_pos")
    joined = left.join(right, ["grp", "contig", "bucket"]).filter((dist > 0) & (dist <= max_dist))
    clean = ~F.col("l_has_missing") & ~F.col("r_has_missing")
    if n_hap is not None and (words := -(-n_hap // 64)) <= UNROLLED:
        a, b, ma, mb = (_words(c, words) for c in ("l_minor", "r_minor", "l_miss", "r_miss"))
        both = ldmath.popcount([x.bitwiseAND(y) for x, y in zip(a, b, strict=True)])
        out = [F.bitwise_not(x.bitwiseOR(y)) for x, y in zip(ma, mb, strict=True)]
        last = n_hap - 64 * (words - 1)
        if last < 64:
            out[-1] = out[-1].bitwiseAND(F.lit((1 << last) - 1))
        ca = ldmath.popcount([x.bitwiseAND(v) for x, v in zip(a, out, strict=True)])
        cb = ldmath.popcount([x.bitwiseAND(v) for x, v in zip(b, out, strict=True)])
        n = ldmath.popcount(out)
    else:
        fold = lambda x, y, f: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(f(p, q)).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)
        missing = F.zip_with("l_miss", "r_miss", lambda p, q: p.bitwiseOR(q))
        both = fold("l_minor", "r_minor", lambda p, q: p.bitwiseAND(q))
        lost = F.aggregate(F.transform(missing, lambda w: F.bit_count(w).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)
        ca = fold("l_minor", missing, lambda p, q: p.bitwiseAND(F.bitwise_not(q)))
        cb = fold("r_minor", missing, lambda p, q: p.bitwiseAND(F.bitwise_not(q)))
        n = F.col("l_n_hap").cast("long") - lost
    # a minor bit is never set where the haplotype is missing, so both-minor needs no mask
    ca = F.when(clean, F.col("l_minor_count").cast("long")).otherwise(ca)
    cb = F.when(clean, F.col("r_minor_count").cast("long")).otherwise(cb)
    n = F.when(clean, F.col("l_n_hap").cast("long")).otherwise(n)
    extra = [F.col(f"{s}_{c}").alias(f"{c}{k}") for c in keep for k, s in ((1, "l"), (2, "r"))]
    table = joined.select("grp", "contig", F.col("l_pos").alias("p1"), F.col("r_pos").alias("p2"), dist.alias("dist"), *extra,
                          both.alias("n11"), ca.alias("ca"), cb.alias("cb"), n.alias("n"))
    kept = [F.col(f"{c}{k}") for c in keep for k in (1, 2)]
    return table.select("grp", "contig", "p1", "p2", "dist", *kept, (F.col("n") - F.col("ca") - F.col("cb") + F.col("n11")).alias("n00"),
                        (F.col("cb") - F.col("n11")).alias("n01"), (F.col("ca") - F.col("n11")).alias("n10"), "n11")


def pair_values(pairs: DataFrame, out_type: int) -> DataFrame:
    """Counted pairs with the columns that the output type needs: rr; d for 2, 4, 6, 7, 8; lod for 7 and 8;
    low and high (hundredths) for 8."""
    pairs = pairs.filter(ldmath.counted(F.col("n11"), F.col("n10"), F.col("n01")))
    n = [F.col(c) for c in _TABLE]
    if out_type == 0:
        return pairs.withColumn("rr", F.lit(None).cast("double")).filter(F.lit(False))
    if out_type in (1, 3, 5):
        return pairs.withColumn("rr", ldmath.r2(*n, left_to_right=out_type == 1))
    if out_type in (2, 4, 6):
        d, rr = ldmath.dprime_r2(*n)
        return pairs.withColumns({"d": d, "rr": rr})
    d, rr, lod = ldmath.dprime_r2_lod(*n)
    out = pairs.withColumns({"d": d, "rr": rr, "lod": lod})
    return with_interval(out) if out_type == 8 else out


def with_interval(pairs: DataFrame) -> DataFrame:
    """low and high of each pair: 101 likelihoods a pair, in Arrow batches."""
    at = [pairs.columns.index(c) for c in _TABLE]
    names = [*pairs.columns, "low", "high"]

    def run(batches):
        for b in batches:
            if b.num_rows:
                low, high = ldmath.likelihood_interval(*[b.column(i).to_numpy() for i in at])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(low.astype(np.int64)), pa.array(high.astype(np.int64))], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.mapInArrow(run, f"{schema}, low long, high long")
