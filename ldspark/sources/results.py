"""Readers of result tables: our own statistics files and other tools' pair tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pairs further apart than this are left out of other tools' tables.
OTHER_MAX_DIST = 300_000
_BINS = "dist long, mean_rr double, mean_d string, sum_rr double, sum_d string, n long"
_HIST4 = "dist long, value double, n_rr long, d_value double, n_d long"
_HIST5 = "dist long, value double, n_rr long"


def kind_of(spark: SparkSession, path: str) -> str:
    """`bins`, `hist4` or `hist5`, by the number of columns of the header."""
    width = len(spark.read.text(path).limit(1).collect()[0][0].split("\t"))
    try:
        return {6: "bins", 5: "hist4", 3: "hist5"}[width]
    except KeyError:
        raise ValueError(f"{path}: {width} columns") from None


def sample_size(spark: SparkSession, path: str) -> int | None:
    rows = spark.read.text(path).filter(F.col("value").startswith("#2SampleSize")).collect()
    return int(rows[0][0].split("\t")[1]) if rows else None


def read_stat(spark: SparkSession, path: str, pop: str = "") -> DataFrame:
    """Bins (pop, dist, n, sum_rr, sum_d) or a histogram (pop, dist, value, n_rr[, n_d]) of a statistics file;
    NA is null."""
    kind = kind_of(spark, path)
    raw = spark.read.schema({"bins": _BINS, "hist4": _HIST4, "hist5": _HIST5}[kind]).csv(path, sep="\t", comment="#")
    raw = raw.withColumn("pop", F.lit(pop))
    if kind == "bins":
        return raw.select("pop", "dist", "n", "sum_rr", F.expr("try_cast(sum_d as double)").alias("sum_d"))
    return raw.select("pop", "dist", "value", "n_rr", *(["n_d"] if kind == "hist4" else []))


def read_stats(spark: SparkSession, paths: list[tuple[str, str]]) -> DataFrame:
    """All files of a list (path, population), added up later by the summaries."""
    out = None
    for path, pop in paths:
        t = read_stat(spark, path, pop)
        out = out.unionByName(t) if out is not None else t
    return out


def _pairs(df: DataFrame, contig, a, b, value, limit: int | None = None) -> DataFrame:
    out = df.select(contig.cast("string").alias("contig"), F.least(a, b).cast("long").alias("p1"), F.greatest(a, b).cast("long").alias("p2"), value.cast("double").alias("rr"))
    return out.filter(F.col("p2") - F.col("p1") <= limit) if limit else out


def _table(spark: SparkSession, path: str) -> DataFrame:
    """A white-space table with a header, as a map column `r` from column name to text."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("c")).filter(F.size("c") > 1)
    names = [r[0].lstrip("#") for r in [(x,) for x in lines.limit(1).collect()[0][0]]]
    rows = lines.filter(F.get("c", F.lit(1)) != names[1])
    return rows.select(F.map_from_arrays(F.array(*map(F.lit, names)), F.slice("c", 1, len(names))).alias("r"))


def read_plink19(spark: SparkSession, path: str) -> DataFrame:
    """CHR_A BP_A SNP_A CHR_B BP_B SNP_B R2 tables."""
    r = lambda c: F.col("r")[c]
    return _pairs(_table(spark, path), r("CHR_A"), r("BP_A").cast("long"), r("BP_B").cast("long"), r("R2"), OTHER_MAX_DIST)


def read_plink2(spark: SparkSession, path: str) -> DataFrame:
    """CHROM_A POS_A .. POS_B .. tables; the value is the column that names r2."""
    t = _table(spark, path)
    name = next(k for k in t.limit(1).collect()[0][0] if "R2" in k.upper())
    r = lambda c: F.col("r")[c]
    return _pairs(t, r("CHROM_A"), r("POS_A").cast("long"), r("POS_B").cast("long"), r(name), OTHER_MAX_DIST)


def read_haploview(spark: SparkSession, path: str) -> DataFrame:
    """L1 L2 D' LOD r^2 tables whose marker names are positions."""
    r = lambda c: F.col("r")[c]
    return _pairs(_table(spark, path), F.lit(""), r("L1").cast("long"), r("L2").cast("long"), r("r^2"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """pos1 pos2 .. r2 tables."""
    r = lambda c: F.col("r")[c]
    return _pairs(_table(spark, path), F.lit(""), r("pos1").cast("long"), r("pos2").cast("long"), r("r2"))
