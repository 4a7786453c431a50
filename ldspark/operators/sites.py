"""From genotype calls to filtered, packed sites.

calls: (grp, contig, pos, seq, input_rank, sample_idx, a, b, miss): one row a sample and site, with the two
alleles as strings. seq is the row's place in its input, input_rank the input's place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LdConfig

KEYS = ["grp", "contig", "pos", "seq", "input_rank"]


def _het() -> Column:
    return ~F.col("miss") & (F.col("a") != F.col("b"))


def _verdict(cfg: LdConfig, mode: str) -> dict[str, Column]:
    """maf and reason from a site's counts."""
    n = F.col("n_samples")
    whole = 2 * n if mode == "genotype_all" else F.col("n_best") + F.col("n_sed")
    maf = F.try_divide(F.col("n_sed"), whole)
    biallelic = F.when((F.col("n_alleles") == 1) | (F.col("n_alleles") > 2), "biallelic")
    rare = F.when(maf < cfg.maf, "maf")
    first = F.coalesce(F.when(F.col("n_miss") / n > cfg.miss, "miss"), F.when(F.col("n_het") / n > cfg.het, "het"))
    if mode == "genotype_all":
        return {"maf": maf, "reason": F.coalesce(first, rare, F.when(F.col("n_alleles") != 2, "biallelic"))}
    return {"maf": maf, "reason": F.coalesce(first, biallelic, rare)}


def _counted(calls: DataFrame, more: list[Column], gathered: list[Column], carried: list[str]) -> DataFrame:
    """Sites with counts, best and second allele. A first aggregate is by site and allele, a second by site; so a
    task holds a few rows a site. more: aggregates of the first; carried: of those, the ones to keep by allele;
    gathered: aggregates of the second."""
    sides = F.array(F.struct(F.col("a").alias("allele"), F.lit(0).alias("side")), F.struct(F.col("b").alias("allele"), F.lit(1).alias("side")))
    long = calls.select(*KEYS, "sample_idx", "miss", _het().alias("het"), F.explode(sides).alias("s"))
    alleles = long.groupBy(*KEYS, F.when(~F.col("miss"), F.col("s.allele")).alias("allele")).agg(
        F.count("*").alias("n"), F.count_if((F.col("s.side") == 0) & F.col("miss")).alias("miss"), F.count_if((F.col("s.side") == 0) & F.col("het")).alias("het"), *more
    )
    own = F.struct((-F.col("n")).alias("less"), F.col("allele").alias("allele"), *carried)
    sites = alleles.groupBy(*KEYS).agg(
        F.expr("sum(n) div 2").alias("n_samples"), F.sum("miss").alias("n_miss"), F.sum("het").alias("n_het"),
        F.array_sort(F.collect_list(F.when(F.col("allele").isNotNull(), own))).alias("by_count"), *gathered,
    )
    best, sed = F.get("by_count", F.lit(0)), F.get("by_count", F.lit(1))
    return sites.withColumns({
        "n_alleles": F.size("by_count"), "best": best["allele"], "sed": sed["allele"],
        "n_best": F.coalesce(-best["less"], F.lit(0)), "n_sed": F.coalesce(-sed["less"], F.lit(0)),
    })


def site_stats(calls: DataFrame, cfg: LdConfig, mode: str = "vcf") -> DataFrame:
    """Counts of each site and the reason it is filtered for, null if it is kept.

    Filters in order: missing rate above cfg.miss, het rate above cfg.het, not exactly two alleles
    (`biallelic`), minor allele frequency below cfg.maf. Two alleles: the more frequent is best, the lower
    character on ties. mode `genotype_all` takes frequencies of all haplotypes, missing ones included, and
    tests them before the number of alleles."""
    return _counted(calls, [], [], []).drop("by_count").withColumns(_verdict(cfg, mode))


def encode(calls: DataFrame, stats: DataFrame, phased: bool) -> DataFrame:
    """calls of kept sites with haplotype values va and vb: 0 best, 1 second, 2 missing or other. Unphased
    heterozygotes are (0, 1)."""
    kept = stats.filter("reason IS NULL").select(*KEYS, "best", "sed")
    value = lambda x: F.when(F.col("miss"), 2).when(F.col(x) == F.col("best"), 0).when(F.col(x) == F.col("sed"), 1).otherwise(2)
    va, vb = value("a"), value("b")
    if not phased:
        het = _het()
        va, vb = F.when(het, 0).otherwise(va), F.when(het, 1).otherwise(vb)
    return calls.join(kept, KEYS).select(*KEYS, "sample_idx", va.alias("va"), vb.alias("vb"))


def pack(values: DataFrame, n_samples: int) -> DataFrame:
    """Sites with bit planes, haplotype 2 s and 2 s + 1 of sample s; partial aggregates do the packing."""
    words = -(-2 * n_samples // 64)
    word, at = F.floor(F.col("sample_idx") / 32).cast("int"), (F.col("sample_idx") % 32 * 2).cast("int")
    bit = lambda v, k: F.when(F.col("va") == v, F.call_function("shiftleft", F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long")).bitwiseOR(
        F.when(F.col("vb") == v, F.call_function("shiftleft", F.lit(1).cast("long"), at + 1)).otherwise(F.lit(0).cast("long"))
    )
    plane = lambda v: F.array(*[F.bit_or(F.when(word == k, bit(v, k)).otherwise(F.lit(0).cast("long"))) for k in range(words)])
    out = values.groupBy(*KEYS).agg(
        plane(1).alias("minor"), plane(2).alias("miss"),
        F.sum((F.col("va") == 1).cast("int") + (F.col("vb") == 1).cast("int")).cast("int").alias("minor_count"),
        F.max((F.col("va") == 2) | (F.col("vb") == 2)).alias("has_missing"),
    )
    return out.select(*KEYS, F.lit(2 * n_samples).alias("n_hap"), "minor", "miss", "minor_count", "has_missing")


def keep_first(sites: DataFrame) -> DataFrame:
    """One row for each (grp, contig, pos): the first kept one by input_rank and seq. A partial aggregate,
    so no position's duplicates are gathered."""
    rest = [c for c in sites.columns if c not in ("grp", "contig", "pos")]
    first = F.min_by(F.struct(*rest), F.struct("input_rank", "seq"))
    return sites.groupBy("grp", "contig", "pos").agg(first.alias("s")).select("grp", "contig", "pos", *[F.col(f"s.{c}").alias(c) for c in rest])


def build_sites(calls: DataFrame, cfg: LdConfig, n_samples: int, phased: bool, mode: str = "vcf") -> DataFrame:
    """calls to unique kept sites. Null positions or contigs are no sites.

    The same as encode and pack, in one pass over the calls: each allele's haplotypes are packed along with its
    count, and a kept site's planes are put together from those of its second allele, of the missing calls
    and of the heterozygotes."""
    words = -(-2 * n_samples // 64)
    word, at = F.floor(F.col("sample_idx") / 32).cast("int"), (F.col("sample_idx") % 32 * 2).cast("int")
    bit, none = F.call_function("shiftleft", F.lit(1).cast("long"), at + F.col("s.side")), F.lit(0).cast("long")
    own = F.array(*[F.bit_or(F.when(word == k, bit).otherwise(none)) for k in range(words)]).alias("plane")
    het = F.array(*[F.bit_or(F.when((word == k) & F.col("het"), bit).otherwise(none)) for k in range(words)]).alias("hets")
    at_word = lambda c, k: F.get(F.col(c), F.lit(k))
    every = lambda c, name: F.array(*[F.bit_or(c(k)) for k in range(words)]).alias(name)
    gathered = [
        every(lambda k: F.when(F.col("allele").isNull(), at_word("plane", k)).otherwise(none), "miss"),
        every(lambda k: at_word("hets", k), "hets"),
    ]
    found = _counted(calls.filter("contig IS NOT NULL AND pos IS NOT NULL"), [own, het], gathered, ["plane"]).withColumns(_verdict(cfg, mode))
    second = F.get("by_count", F.lit(1))["plane"]
    # the second haplotype of each sample, which is where an unphased heterozygote has its second allele
    second_side = F.lit(sum(1 << k for k in range(1, 64, 2)) - (1 << 64)).cast("long")
    minor = []
    for k in range(words):
        w = F.coalesce(F.get(second, F.lit(k)), none)
        if not phased:
            h = at_word("hets", k)
            w = w.bitwiseAND(F.bitwise_not(h)).bitwiseOR(h.bitwiseAND(second_side))
        minor.append(w)
    kept = found.filter("reason IS NULL").withColumn("minor", F.array(*minor))
    ones = sum((F.bit_count(at_word("minor", k)) for k in range(1, words)), F.bit_count(at_word("minor", 0))).cast("int")
    return keep_first(kept.select(*KEYS, F.lit(2 * n_samples).alias("n_hap"), "minor", "miss", ones.alias("minor_count"), (F.col("n_miss") > 0).alias("has_missing")))


def union_inputs(*inputs: DataFrame) -> DataFrame:
    """Sites of several inputs: on equal positions the earlier input's wins."""
    out = None
    for rank, sites in enumerate(inputs):
        sites = sites.withColumn("input_rank", F.lit(rank))
        out = out.unionByName(sites) if out is not None else sites
    return keep_first(out)


def by_group(calls: DataFrame, groups: DataFrame) -> DataFrame:
    """calls of each sample group: groups (grp, sample_idx, new_idx) is the small table that says which
    samples a group has, in header order."""
    picked = calls.drop("grp").join(F.broadcast(groups), "sample_idx").drop("sample_idx")
    return picked.withColumnRenamed("new_idx", "sample_idx").select(*calls.columns)


def minor_allele_frequency(sites: DataFrame) -> Column:
    return F.col("minor_count") / F.col("n_hap")
