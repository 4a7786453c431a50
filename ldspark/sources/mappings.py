"""Genotype calls from plain tables.

EMB reads `embeddings`: a site a row, 64 phased haplotypes, allele 1 where a component is positive. LI
reads `lineitem`: 20 samples, the first two rows of a cell are its alleles, a cell with fewer is missing.
LIM is LI with more cells missing. All use exact comparisons and whole numbers only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EMB_SAMPLES, LI_SAMPLES = 32, 20


def emb_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    allele = lambda k: F.when(F.get("embedding", k) > 0, "1").otherwise("0")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(EMB_SAMPLES - 1)), lambda s: F.struct(s.alias("s"), allele(2 * s).alias("a"), allele(2 * s + 1).alias("b")))
    return rows.select("vec_id", "label", F.explode(pairs).alias("c")).select(
        F.lit("").alias("grp"), F.concat(F.lit("e"), F.col("label") % 3).alias("contig"), (F.col("vec_id") * 137 + 1000).alias("pos"), F.col("vec_id").alias("seq"),
        F.lit(0).alias("input_rank"), F.col("c.s").alias("sample_idx"), F.col("c.a").alias("a"), F.col("c.b").alias("b"), F.lit(False).alias("miss"),
    )


def li_calls(spark: SparkSession, sf_dir: str, more_missing: bool = False) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_linestatus")
    cell = ["contig", "pos", "sample_idx"]
    keyed = rows.select(
        F.col("l_linestatus").alias("contig"), (F.col("l_partkey") % 40 * 1500 + 1000).alias("pos"), (F.col("l_orderkey") % LI_SAMPLES).cast("int").alias("sample_idx"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_quantity") > 25, "1").otherwise("0").alias("allele"),
        ((F.col("l_partkey") * 7 + F.col("l_orderkey")) % 9 == 0).alias("marked"),
    )
    nth = F.row_number().over(Window.partitionBy(*cell).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    first = keyed.withColumn("nth", nth).filter("nth <= 2")  # pruned before the shuffle
    out = first.groupBy(*cell).agg(
        F.max(F.when(F.col("nth") == 1, F.col("allele"))).alias("a"), F.max(F.when(F.col("nth") == 2, F.col("allele"))).alias("b"),
        F.max(F.when(F.col("nth") == 1, F.col("marked"))).alias("marked"),
    )
    miss = F.col("b").isNull() | F.col("marked") if more_missing else F.col("b").isNull()
    sites = out.select("contig", "pos").distinct()
    every = sites.select("contig", "pos", F.explode(F.sequence(F.lit(0), F.lit(LI_SAMPLES - 1))).alias("sample_idx"))
    full = every.join(out.select(*cell, "a", "b", miss.alias("miss")), cell, "left")
    return full.select(
        F.lit("").alias("grp"), "contig", F.col("pos").cast("long").alias("pos"), F.col("pos").cast("long").alias("seq"), F.lit(0).alias("input_rank"), "sample_idx",
        "a", F.coalesce("b", "a").alias("b"), F.coalesce("miss", F.lit(True)).alias("miss"),
    )
