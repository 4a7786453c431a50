"""Command line for summaries of statistics files: python -m ldspark.rebin_cli -inFile x.stat.gz -output out [options]"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .config import OptionError, rate, whole
from .operators import hw, rebin
from .sources import results

USAGE = """options: -inFile FILE | -inList LIST (path, or path and population), -output PREFIX, -bin1 10, -bin2 100, -break 100,
-maxX KB, -measure r2|D|both (r2), -method MeanBin|HW|MedianBin|PercentileBin (MeanBin), -percent .5, -help"""
#: Names of methods and measures.
METHODS, MEASURES = ("MeanBin", "HW", "MedianBin", "PercentileBin"), {"r2": ("r2",), "D": ("D",), "both": ("r2", "D")}


@dataclass(frozen=True)
class RebinConfig:
    """Which files to sum up and how; `at` is the distance where bins of bin1 end and those of bin2 begin."""

    files: tuple[tuple[str, str], ...]
    output: str
    bin1: int = 10
    bin2: int = 100
    at: int = 100
    max_kb: float | None = None
    measure: str = "r2"
    method: str = "MeanBin"
    percent: float = 0.5


def read_list(path: str) -> list[tuple[str, str]]:
    """(path, population) of lines with one or two columns; without a second column all are one population."""
    with open(path) as f:
        rows = [line.split() for line in f if line.strip() and not line.startswith("#")]
    return [(r[0], r[1] if len(r) > 1 else "") for r in rows]


def parse(args: list[str]) -> RebinConfig | None:
    """None: help is asked for."""
    found: dict[str, str] = {}
    rest = list(args)
    while rest:
        flag = rest.pop(0)
        name = flag.lstrip("-")
        if name in ("help", "h"):
            return None
        if name not in ("inFile", "inList", "output", "bin1", "bin2", "break", "maxX", "measure", "method", "percent") or not rest:
            raise OptionError(f"unknown option or no value: {flag}")
        found[name] = rest.pop(0)
    if ("inFile" in found) == ("inList" in found) or "output" not in found:
        raise OptionError("-output and one of -inFile, -inList are needed")
    files = [(found["inFile"], "")] if "inFile" in found else read_list(found["inList"])
    if not files:
        raise OptionError(f"no file in {found['inList']}")
    cfg = RebinConfig(
        tuple(files), found["output"], *(whole(found.get(n, d)) for n, d in (("bin1", "10"), ("bin2", "100"), ("break", "100"))),
        float(found["maxX"]) if "maxX" in found else None, found.get("measure", "r2"), found.get("method", "MeanBin"), rate(found.get("percent", "0.5")),
    )
    if cfg.measure not in MEASURES or cfg.method not in METHODS:
        raise OptionError(f"not a measure or method: {cfg.measure}, {cfg.method}")
    if min(cfg.bin1, cfg.bin2) < 1:
        raise OptionError("bins are of 1 or more")
    return cfg


def execute(spark: SparkSession, cfg: RebinConfig) -> dict[str, str]:
    """Write the summaries; gives the files by kind and population."""
    kinds = {results.kind_of(spark, p) for p, _ in cfg.files}
    if len(kinds) > 1:
        raise ValueError(f"files of different kinds: {sorted(kinds)}")
    kind = kinds.pop()
    table = results.read_stats(spark, list(cfg.files))
    if cfg.max_kb is not None:
        table = table.filter(F.col("dist") <= cfg.max_kb * 1000)
    sizes = {pop: [] for _, pop in cfg.files}
    if kind != "bins":
        for path, pop in cfg.files:
            sizes[pop].append(results.sample_size(spark, path) or 0)
        n_hap = {pop: rebin.check_sizes(found) for pop, found in sizes.items()}
        table = rebin.merged_values(table)
    elif cfg.method != "MeanBin":
        raise ValueError(f"{cfg.method} needs files of output type 4 or 5")
    if "D" in MEASURES[cfg.measure] and kind == "hist5":
        raise ValueError("files of output type 5 have no D'")
    out: dict[str, str] = {}
    for pop in sizes:
        mine, prefix = table.filter(F.col("pop") == pop), sinks.group_prefix(cfg.output, pop)
        if cfg.method == "MeanBin":
            as_bins = mine if kind == "bins" else rebin.histogram_as_bins(mine)
            sinks.write_mean_bins(rebin.mean_bins(as_bins, cfg.bin1, cfg.bin2, cfg.at), f"{prefix}.bin.gz")
            out[f"bin {pop}"] = f"{prefix}.bin.gz"
            continue
        for measure in MEASURES[cfg.measure]:
            path = f"{prefix}.{measure}.{cfg.method}.gz"
            sinks.write_curve(_curve(mine, cfg, measure, n_hap[pop]), path)
            out[f"{cfg.method} {measure} {pop}"] = path
    return out


def _curve(mine: DataFrame, cfg: RebinConfig, measure: str, n_hap: int) -> DataFrame:
    """(x, value) of one population's histogram."""
    count = "n_rr" if measure == "r2" else "n_d"
    if cfg.method == "HW":
        points = mine.filter(F.col(count) > 0).select("dist", "value", F.col(count).alias("weight"))
        return hw.fitted_curve(points, hw.fit(points, n_hap), n_hap).select(F.col("dist").alias("x"), F.col("fitted").alias("value"))
    share = 0.5 if cfg.method == "MedianBin" else cfg.percent
    return rebin.quantile_bins(mine, share, cfg.bin1, cfg.bin2, cfg.at, count).select(F.col("bin_start").alias("x"), "value", "is_long")


def main(args: list[str]) -> int:
    try:
        cfg = parse(args)
    except (OptionError, OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    if cfg is None:
        print(USAGE)
        return 1
    spark = SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    try:
        for kind, path in execute(spark, cfg).items():
            print(f"{kind.strip()}\t{path}")
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
