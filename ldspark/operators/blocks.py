"""Distance bins by dense blocks, for many haplotypes or dense contigs.

A block owns the pairs whose left site is in it and also reads the sites up to the largest distance
behind it. Both-minor counts of a stretch of left sites with all right sites are one matrix product, so
a pair costs a few flops a haplotype and only bins leave the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ldmath

#: Left sites of one product.
STRETCH = 256


def planes(column, n_hap: int) -> np.ndarray:
    """Bit planes (arrays of 64-bit words, lowest bit first) as a matrix of 0 and 1, a row for each site."""
    words = np.array(column, dtype=np.int64).reshape(len(column), -1)
    return np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")[:, :n_hap].astype(np.float32)


def block_bins(pos, minor, miss, n_left: int, max_dist: int, out_type: int):
    """Sums over pairs (i, j), i < n_left, 0 < pos[j] - pos[i] <= max_dist of sites sorted by position:
    count, r2 and D' by distance."""
    n, rr, dd = (np.zeros(max_dist + 1) for _ in range(3))
    valid = 1 - miss
    clean = not miss.any()
    for a in range(0, n_left, STRETCH):
        b = min(a + STRETCH, n_left)
        end = np.searchsorted(pos, pos[b - 1] + max_dist, side="right")
        dist = pos[None, a:end] - pos[a:b, None]
        i, j = np.nonzero((dist > 0) & (dist <= max_dist))
        if not len(i):
            continue
        n11 = (minor[a:b] @ minor[a:end].T)[i, j].astype(np.int64)
        if clean:
            ones = minor[a:end].sum(axis=1).astype(np.int64)
            ca, cb, total = ones[i], ones[j], np.full(len(i), minor.shape[1], np.int64)
        else:
            ca = (minor[a:b] @ valid[a:end].T)[i, j].astype(np.int64)
            cb = (valid[a:b] @ minor[a:end].T)[i, j].astype(np.int64)
            total = (valid[a:b] @ valid[a:end].T)[i, j].astype(np.int64)
        ok = (ca > 0) & (cb > 0)
        at, n11, ca, cb, total = dist[i, j][ok], n11[ok], ca[ok], cb[ok], total[ok]
        table = (total - ca - cb + n11, cb - n11, ca - n11, n11)
        if out_type in (1, 3, 5):
            r, d = ldmath.r2(*table, ldmath.arrays, out_type == 1), None
        elif out_type in (2, 4, 6):
            d, r = ldmath.dprime_r2(*table, ldmath.arrays)
        else:
            d, r, _ = ldmath.dprime_r2_lod(*table, ldmath.arrays)
        n += np.bincount(at, minlength=max_dist + 1)
        rr += np.bincount(at, r, max_dist + 1)
        if d is not None:
            dd += np.bincount(at, d, max_dist + 1)
    return n, rr, dd


def decay_by_blocks(sites: DataFrame, out_type: int, max_dist: int, block_bp: int | None = None) -> DataFrame:
    """The rows of aggregates.decay, made by the block kernel."""
    width = max(block_bp or max_dist, max_dist)
    own = F.floor(F.col("pos") / width).cast("long")
    copies = F.array_distinct(F.array(own, F.floor((F.col("pos") - max_dist) / width).cast("long")))
    rows = sites.select("grp", "contig", "pos", "n_hap", "minor", "miss", own.alias("own"), F.explode(copies).alias("block")).filter("block >= 0")

    def run(table: pa.Table) -> pa.Table:
        grp, block = table.column("grp")[0].as_py(), table.column("block")[0].as_py()
        table = table.sort_by("pos")
        pos = table.column("pos").to_numpy()
        n_hap = table.column("n_hap")[0].as_py()
        n_left = int((table.column("own").to_numpy() == block).sum())
        minor, miss = (planes(table.column(c).to_pylist(), n_hap) for c in ("minor", "miss"))
        n, rr, dd = block_bins(pos, minor, miss, n_left, max_dist, out_type)
        at = np.flatnonzero(n)
        return pa.table({"grp": pa.array([grp] * len(at), pa.string()), "dist": pa.array(at, pa.int64()), "n": pa.array(n[at].astype(np.int64)), "sum_rr": rr[at], "sum_d": dd[at]})

    parts = rows.groupBy("grp", "contig", "block").applyInArrow(run, "grp string, dist long, n long, sum_rr double, sum_d double")
    sum_d = F.sum("sum_d") if out_type in (2, 4) else F.lit(0.0) if out_type == 3 else F.lit(None).cast("double")
    out = parts.groupBy("grp", "dist").agg(F.sum("n").alias("n"), F.sum("sum_rr").alias("sum_rr"), sum_d.alias("sum_d"))
    return out.select("grp", "dist", "n", "sum_rr", (F.col("sum_rr") / F.col("n")).alias("mean_rr"), "sum_d", (F.col("sum_d") / F.col("n")).alias("mean_d"))
