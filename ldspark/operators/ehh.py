"""Extended haplotype homozygosity around a core site."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import planes

#: The least number of sites, and where the decay stops.
LEAST_SITES, STOP = 8, 0.088
SCHEMA = "contig string, pos long, dist long, ehh_all double, ehh_0 double, ehh_1 double"


def parse_core(text: str) -> tuple[str, int]:
    parts = [p for p in text.split(":") if p]
    if len(parts) < 2 or not parts[1].isdigit():
        raise ValueError(f"not chromosome:position: {text}")
    return parts[0], int(parts[1])


def _extend(haps: np.ndarray, core: int, order) -> dict[int, tuple[float, float]]:
    """Homozygosity after each step away from the core: classes of equal haplotypes are refined by one
    site's alleles at a time, which needs one class number a haplotype."""
    n = haps.shape[1]
    cls = haps[core].astype(np.int64)
    out = {}
    for k in order:
        _, cls = np.unique(cls * 2 + haps[k], return_inverse=True)
        sizes = np.bincount(cls)
        pairs = sizes * (sizes - 1)
        zero = np.zeros(len(sizes), bool)
        zero[cls[haps[core] == 0]] = True
        out[k] = pairs.sum() / (n * (n - 1)), pairs[zero].sum() / (n * (n - 1))
        if out[k][0] < STOP:
            break
    return out


def decay(pos: np.ndarray, haps: np.ndarray, at: int, strict_compat: bool = True) -> list[tuple[float, float]]:
    """(all, with the core's allele 0) for each site; 0 where the decay did not get to.

    The core is the last site at or before `at`; if that is the first site the second is taken, and if
    there is none the last but one, as established. Without strict_compat the first site is taken."""
    last = int(np.searchsorted(pos, at, side="right")) - 1
    core = last
    if strict_compat:
        # no site at or before the position counts like the end of the list
        core = len(pos) - 2 if last < 0 else max(1, last)
    core = max(0, core)
    n = haps.shape[1]
    zeros = int((haps[core] == 0).sum())
    ones = n - zeros
    zero = zeros * (zeros - 1) / (n * (n - 1))
    found = {core: (ones * (ones - 1) / (n * (n - 1)) + zero, zero)}
    found |= _extend(haps, core, range(core - 1, -1, -1))
    found |= _extend(haps, core, range(core + 1, len(pos)))
    return [found.get(k, (0.0, 0.0)) for k in range(len(pos))]


def ehh_decay(sites: DataFrame, contig: str, at: int, max_dist: int, strict_compat: bool = True) -> DataFrame:
    """(contig, pos, dist, ehh_all, ehh_0, ehh_1) of the sites without missing haplotypes within max_dist of
    the core; no rows for an unknown contig or fewer than LEAST_SITES sites.

    One core's window is one sequential computation; its size is bounded by max_dist, not by the input."""
    window = sites.filter((F.col("contig") == contig) & F.col("pos").between(max(0, at - max_dist), at + max_dist) & ~F.col("has_missing"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        pos = table.column("pos").to_numpy()
        if len(pos) < LEAST_SITES:
            return pa.table({c.split()[0]: pa.array([], pa.string() if "string" in c else pa.int64() if "long" in c else pa.float64()) for c in SCHEMA.split(", ")})
        haps = planes(table.column("minor").to_pylist(), table.column("n_hap")[0].as_py()).astype(np.int64)
        values = np.array(decay(pos, haps, at, strict_compat))
        return pa.table({"contig": table.column("contig"), "pos": pos, "dist": pos - at, "ehh_all": values[:, 0], "ehh_0": values[:, 1], "ehh_1": values[:, 0] - values[:, 1]})

    return window.select("contig", "pos", "n_hap", "minor").groupBy("contig").applyInArrow(run, SCHEMA)
