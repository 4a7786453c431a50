"""Pair functions by name in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import ldmath


def register(spark: SparkSession) -> list[str]:
    """ld_r2, ld_dprime and ld_lod (n00, n01, n10, n11): temporary SQL functions whose bodies are the Column
    expressions, so they are optimized and compiled like any other expression."""
    from pyspark.sql import functions as F

    n = [F.col(c) for c in ("n00", "n01", "n10", "n11")]
    bodies = {"ld_r2": ldmath.r2(*n), "ld_dprime": ldmath.dprime_r2(*n)[0], "ld_lod": ldmath.dprime_r2_lod(*n)[2]}
    for name, body in bodies.items():
        text = _sql(spark, body)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(n00 BIGINT, n01 BIGINT, n10 BIGINT, n11 BIGINT) RETURNS DOUBLE RETURN CASE WHEN n11 + n10 > 0 AND n11 + n01 > 0 THEN {text} END")
    return list(bodies)


def _sql(spark: SparkSession, column) -> str:
    """SQL text of an expression over the four counts."""
    frame = spark.range(0).selectExpr("id AS n00", "id AS n01", "id AS n10", "id AS n11").select(column.alias("v"))
    return frame._jdf.queryExecution().analyzed().expressions().head().child().sql()
