"""A run: inputs to result files, for the command line."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..config import LdConfig
from ..operators import aggregates, blocks, ehh, pairs, regions
from ..operators.sites import union_inputs
from ..session import ship
from ..sources import files, store


#: Output types of which only bins are written; for wide panels these come from the block kernel.
BLOCK_TYPES = (1, 2)


def input_names(spark: SparkSession, cfg: LdConfig) -> list[str] | None:
    if cfg.in_vcf:
        return files.vcf_header(spark, cfg.in_vcf).names
    if cfg.in_plink:
        return files.plink_names(spark, cfg.in_plink)
    if cfg.in_sites:
        raise ValueError("-SubPop: stored sites have their groups already")
    return files.genotype_names(spark, cfg.in_genotype) if cfg.sub_pop else None


def load(spark: SparkSession, cfg: LdConfig) -> tuple[list[DataFrame], files.Groups]:
    """Parsed sites of each input, kept and skipped, and the sample groups."""
    groups: files.Groups = [("", None)]
    if cfg.sub_pop:
        groups = files.resolve(files.sample_groups(cfg.sub_pop), input_names(spark, cfg))
    where = regions.load_regions(cfg.region) if cfg.region else None
    lines = cfg.out_filter and not cfg.sub_pop
    found = []
    if cfg.in_sites:
        stored = store.read_sites(spark, cfg.in_sites, where)
        if where:
            stored = regions.assign(stored, regions.region_frame(spark, where), cfg.strict_compat)
        found.append(stored.withColumns({"reason": F.lit(None).cast("string"), "line": F.lit(None).cast("string")}))
        groups = [(r["grp"], None) for r in stored.select("grp").distinct().orderBy("grp").collect()]
    if cfg.in_vcf:
        found.append(files.read_vcf(spark, cfg.in_vcf, cfg, groups, where, lines))
    if cfg.in_genotype:
        found.append(files.read_genotype(spark, cfg.in_genotype, cfg, groups, lines, rank=1))
    if cfg.in_plink:
        found.append(files.read_plink(spark, cfg.in_plink, cfg, groups, where, lines))
    return found, groups


def execute(spark: SparkSession, cfg: LdConfig, say=print) -> dict[str, str]:
    """Run and write; gives the files by kind and group. A group that fails leaves no file."""
    ship(spark)
    if cfg.ehh:
        if len(cfg.sub_pop) and len(files.sample_groups(cfg.sub_pop)) > 1:
            raise ValueError("-EHH takes one sample group")
        cfg = cfg.__class__(**{**cfg.__dict__, "maf": max(cfg.maf, 0.05)})
    if cfg.in_vcf:
        for message in files.vcf_header(spark, cfg.in_vcf).messages():
            say(message)
    parsed, groups = load(spark, cfg)
    parsed = [p.persist() for p in parsed]
    try:
        return _write(spark, cfg, parsed, groups, say)
    finally:
        for p in parsed:
            p.unpersist()


def _write(spark, cfg: LdConfig, parsed: list[DataFrame], groups, say) -> dict[str, str]:
    prefix, out = sinks.stat_prefix(cfg.out_stat), {}
    for p in parsed:
        for r in aggregates.skip_counts(p).orderBy("grp", "reason").collect():
            say(f"{r['grp'] or 'all samples'}: {r['reason']} {r['n']}")
    sites = union_inputs(*[files.kept(p).drop("input_rank") for p in parsed]).persist()
    for r in sites.groupBy("grp").agg(F.count("*").alias("n"), F.count_distinct("contig").alias("contigs"), F.max("n_hap").alias("haps")).orderBy("grp").collect():
        say(f"{r['grp'] or 'all samples'}: {r['n']} sites of {r['contigs']} contigs, {r['haps']} haplotypes; MaxDist {cfg.max_kb} kb, OutType {cfg.out_type}")
    if cfg.out_sites:
        store.write_sites(sites.withColumn("input_rank", F.lit(0)), cfg.out_sites, "overwrite")
        out["sites"] = cfg.out_sites
    for label, _ in groups:
        mine = sites.filter(F.col("grp") == label)
        at = sinks.group_prefix(prefix, label)
        widths = [r[0] for r in mine.select("n_hap").distinct().limit(2).collect()]
        n_hap = widths[0] if len(widths) == 1 else None
        if cfg.ehh:
            contig, core = ehh.parse_core(cfg.ehh)
            out[f"ehh {label}"] = f"{at}.ehh.gz"
            sinks.write_ehh(ehh.ehh_decay(mine, contig, core, cfg.max_dist, cfg.strict_compat), f"{at}.ehh.gz")
            continue
        if cfg.out_type in BLOCK_TYPES and n_hap is not None and n_hap > 64 * pairs.UNROLLED:
            sinks.write_bins(blocks.decay_by_blocks(mine, cfg.out_type, cfg.max_dist), f"{at}.stat.gz")
            out[f"stat {label}"] = f"{at}.stat.gz"
            continue
        values = pairs.pair_values(pairs.pair_tables(mine, cfg.max_dist, n_hap), cfg.out_type)
        if cfg.out_type in (4, 5):
            sinks.write_histogram(aggregates.value_histogram(values, cfg.out_type, cfg.max_dist, cfg.strict_compat), f"{at}.stat.gz", cfg.out_type, n_hap or 0)
        else:
            sinks.write_bins(aggregates.distance_bins(values, cfg.out_type) if cfg.out_type else aggregates.decay(mine, 0, cfg.max_dist), f"{at}.stat.gz")
        out[f"stat {label}"] = f"{at}.stat.gz"
        if cfg.out_type in aggregates.PAIR_TYPES:
            sinks.write_pairs(values, f"{at}.LD.gz", cfg.out_type)
            out[f"LD {label}"] = f"{at}.LD.gz"
    if cfg.out_filter and not cfg.sub_pop:
        names = iter((("vcf", cfg.in_vcf), ("genotype", cfg.in_genotype), ("plink", cfg.in_plink)))
        for p, (kind, path) in zip(parsed, [n for n in names if n[1]], strict=True):
            name = f"{prefix}.{kind}.filter.{'bim' if kind == 'plink' else 'gz'}"
            header = []
            if kind == "vcf":
                header = [r[0] for r in spark.read.text(path).filter(F.col("value").startswith("#")).collect()]
            sinks.write_filtered(p, name, header)
            if kind == "plink":
                _ungzip(name)
            out[f"filter {kind}"] = name
    sites.unpersist()
    return out


def _ungzip(path: str) -> None:
    import gzip

    with gzip.open(path, "rt") as f:
        text = f.read()
    with open(f"{path}.part", "w") as f:
        f.write(text)
    os.replace(f"{path}.part", path)
