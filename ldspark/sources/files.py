"""Readers of genotype files as sites: VCF, IUPAC genotype tables, PLINK bed/bim/fam, PED/MAP.

Each gives a DataFrame of sites and skipped sites, (grp, contig, pos, seq, input_rank, n_hap, minor, miss,
minor_count, has_missing, reason, line): reason is null for kept sites, whose planes are set. Text is read
as lines with their place in the file; a compressed file is one split, so its lines are dealt out again
right after the scan. Lines are parsed once, in Arrow batches, for all sample groups together.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LdConfig
from .encoding import Site, encode, iupac_alleles

SCHEMA = (
    "grp string, contig string, pos long, seq long, input_rank int, n_hap int, minor array<long>, miss array<long>, "
    "minor_count int, has_missing boolean, reason string, line string"
)
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()),
          pa.int32(), pa.bool_(), pa.string(), pa.string()]
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]

#: (label, indices of samples); None for all samples.
Groups = list[tuple[str, list[int] | None]]


def lines_of(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """(seq, value) of a text file in any compression Spark reads, seq counting from 0. Lines are numbered by their
    place in a split after the lines of the splits before it, which are counted first."""
    rows = spark.read.text(path).withColumn("__id", F.monotonically_increasing_id())
    split, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    counts = {r["split"]: r["n"] for r in rows.groupBy(split.alias("split")).agg(F.count("*").alias("n")).collect()}  # a row for each split
    before, starts = 0, []
    for k in range(max(counts, default=-1) + 1):
        starts.append(before)
        before += counts.get(k, 0)
    start = F.get(F.split(F.lit(" ".join(map(str, starts)) or "0"), " ").cast("array<long>"), split.cast("int"))
    out = rows.select("value", (start + place).alias("seq"))
    return out.repartition(partitions or spark.sparkContext.defaultParallelism, "seq") if path.endswith((".gz", ".bgz")) else out


def _row(grp: str, contig: str, pos: int, seq: int, rank: int, n: int, site: Site, line: str | None) -> tuple:
    kept = site.reason is None
    minor = site.minor.tolist() if kept else None
    miss = site.miss.tolist() if kept else None
    ones = int(np.bitwise_count(site.minor.view("<u8")).sum()) if kept else None  # of signed words it counts absolute values
    return grp, contig, pos, seq, rank, 2 * n, minor, miss, ones, bool(site.miss.any()) if kept else None, site.reason, line


def _sites(rows: DataFrame, parse, keep_lines: bool) -> DataFrame:
    """parse(seq, value) gives rows; null and blank lines are no sites."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [r if keep_lines else (*r[:-1], None) for v, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if v for r in parse(s, v)]
            cols = zip(*out, strict=True) if out else [[]] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], _NAMES)

    return rows.select("value", "seq").mapInArrow(run, SCHEMA)


def kept(sites: DataFrame) -> DataFrame:
    return sites.filter("reason IS NULL").drop("reason", "line")


# --- VCF -----------------------------------------------------------------------------------------------


class VcfHeader:
    """Sample names, phase and ploidy from the head of a file."""

    def __init__(self, names: list[str], phased: bool, haploid: str | None = None, polyploid: str | None = None):
        """haploid, polyploid: the first sample with such a call ('' if it has no name), None if there is none."""
        self.names, self.phased, self.haploid_sample, self.polyploid_sample = names, phased, haploid, polyploid
        self.haploid, self.polyploid = haploid is not None, polyploid is not None

    @property
    def ploidy_aware(self) -> bool:
        return self.haploid or self.polyploid

    def messages(self) -> list[str]:
        """What a user should know of the ploidy; nothing if all calls are diploid."""
        out = []
        if self.polyploid:
            out.append(f"warning: polyploid GT detected in sample {self.polyploid_sample}; only the first two alleles count, such input is not recommended")
        if self.haploid:
            out.append(f"ploidy: haploid GT detected in sample {self.haploid_sample}; haploid calls count as homozygous diploid")
        return out


def vcf_header(spark: SparkSession, path: str) -> VcfHeader:
    """Read up to the first five records. Phase is that of the first record's first sample; ploidy looks at all
    samples of the five, without missing ones."""
    text = spark.read.text(path)
    head = text.filter(~F.col("value").startswith("##")).limit(6).collect()
    if not head or not head[0][0].startswith("#CHROM"):
        raise ValueError(f"{path}: no #CHROM line before the data")
    names = head[0][0].rstrip("\r\n").split("\t")[9:]
    records = [r[0].split("\t")[9:] for r in head[1:]]
    phased = bool(records) and bool(records[0]) and records[0][0][1:2] == "|"
    haploid = polyploid = None
    for fields in records:
        for k, f in enumerate(fields):
            gt = f.split(":", 1)[0]
            if not set(gt) - set("./|"):
                continue
            marks, name = gt.count("/") + gt.count("|"), names[k] if k < len(names) else ""
            if not marks and len(gt) == 1 and haploid is None:
                haploid = name
            if marks > 1 and polyploid is None:
                polyploid = name
    return VcfHeader(names, phased, haploid, polyploid)


def vcf_alleles(line: str, fields: list[str], first: int, aware: bool) -> tuple[np.ndarray, np.ndarray]:
    """First and third character of each sample's field. Where ploidy is not looked at, a field too short for
    that goes on into the rest of the line, as the established reader has it."""
    a = "".join(f[:1] or "\0" for f in fields)
    if all(len(f) > 2 for f in fields):
        b = "".join(f[2] for f in fields)
    elif aware:
        b = "".join(f[0] if len(f.split(":", 1)[0]) == 1 else f[2:3] or "\0" for f in fields)
    else:
        out, at = [], first
        for f in fields:
            out.append(line[at + 2 : at + 3] or "\0")
            at += len(f) + 1
        b = "".join(out)
    return tuple(np.frombuffer(s.encode("latin-1", "replace"), np.uint8) for s in (a, b))


def read_vcf(spark: SparkSession, path: str, cfg: LdConfig, groups: Groups = (("", None),), regions: list | None = None, keep_lines: bool = False, rank: int = 0) -> DataFrame:
    """Sites of a VCF. regions: (contig, start, end, label) of regions.load_regions; a site takes the label of
    its region as contig and others are left out before their genotypes are parsed."""
    head = vcf_header(spark, path)
    phased, aware, strict = head.phased, head.ploidy_aware, cfg.strict_compat
    by_contig = _by_contig(regions)

    def parse(seq: int, line: str):
        if line.startswith("#"):
            return
        cols = line.split("\t", 9)
        if len(cols) < 10 or not cols[0]:
            return
        contig, pos = cols[0], int(cols[1])
        for label in _labels(by_contig, contig, pos, strict):
            if len(cols[3]) > 1 or any(len(x) > 1 for x in cols[4].split(",")):
                yield from ((g, label, pos, seq, rank, None, None, None, None, None, "indel", line) for g, _ in groups)
                continue
            fields = cols[9].split("\t")
            a, b = vcf_alleles(line, fields, len(line) - len(cols[9]), aware)
            for g, pick in groups:
                x, y = (a, b) if pick is None else (a[pick], b[pick])
                yield _row(g, label, pos, seq, rank, len(x), encode(x, y, cfg, "vcf", phased), line)

    return _sites(lines_of(spark, path), parse, keep_lines)


def _by_contig(regions: list | None) -> dict | None:
    if regions is None:
        return None
    out: dict = {}
    for contig, start, end, label in sorted(regions, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(contig, []).append((start, end, label))
    return out


def _labels(by_contig: dict | None, contig: str, pos: int, strict: bool) -> list[str]:
    if by_contig is None:
        return [contig]
    around = [r for r in by_contig.get(contig, ()) if r[0] <= pos]
    if strict:
        around = around[-1:]
    return [label for _, end, label in around if pos <= end]


# --- IUPAC genotype tables -----------------------------------------------------------------------------


def genotype_names(spark: SparkSession, path: str) -> list[str]:
    head = spark.read.text(path).limit(1).collect()
    if not head or not head[0][0].startswith("#"):
        raise ValueError(f"{path}: sample groups need a header line")
    return head[0][0].split()[2:]


def read_genotype(spark: SparkSession, path: str, cfg: LdConfig, groups: Groups = (("", None),), keep_lines: bool = False, rank: int = 0) -> DataFrame:
    """Sites of lines `chr pos code code ...`. Lines with # or fewer than three columns are no sites. Regions do
    not apply to this format."""

    def parse(seq: int, line: str):
        cols = line.split()
        if line.startswith("#") or len(cols) < 3:
            return
        tokens = cols[2:]
        for g, pick in groups:
            mine = tokens if pick is None else [tokens[k] for k in pick]
            a, b = iupac_alleles(mine)
            mode = "genotype_all" if pick is None else "genotype_group"
            yield _row(g, cols[0], int(cols[1]), seq, rank, len(mine), encode(a, b, cfg, mode, False, mine), line)

    return _sites(lines_of(spark, path), parse, keep_lines)


# --- PLINK ---------------------------------------------------------------------------------------------

#: The file's first bytes, and characters of the two-bit codes (A1 A1, missing, het, A2 A2).
MAGIC = bytes((0x6C, 0x1B, 0x01))
_FIRST, _SECOND = np.frombuffer(b"0.01", np.uint8), np.frombuffer(b"0.11", np.uint8)


def plink_prefix(path: str) -> str:
    return path[:-4] if path.endswith((".bed", ".bim", ".fam")) else path


def plink_names(spark: SparkSession, path: str) -> list[str]:
    """Sample ids in file order; an id twice is an error."""
    rows = spark.read.text(plink_prefix(path) + ".fam").collect()
    names = [r[0].split()[1] for r in rows if r[0].strip()]
    if len(set(names)) < len(names):
        raise ValueError(f"{path}: a sample id twice in .fam")
    return names


def unpack_bed(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Allele characters of one variant's bytes; the first sample has the lowest bits."""
    codes = (np.frombuffer(raw, np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).ravel()[:n]
    return _FIRST[codes], _SECOND[codes]


def read_plink(spark: SparkSession, path: str, cfg: LdConfig, groups: Groups = (("", None),), regions: list | None = None, keep_lines: bool = False, rank: int = 0) -> DataFrame:
    """Sites of prefix.bed/.bim/.fam, variant-major. Alleles other than one of ACGT (any case) are indels and
    are skipped before regions; the line kept is the .bim line with cm 0 and upper-case alleles.

    Tasks seek to their variants' records in the .bed file, so it has to be on a path that executors can
    open (a shared or local file system)."""
    prefix = plink_prefix(path)
    n = len(plink_names(spark, prefix))
    width = -(-n // 4)
    bim = lines_of(spark, prefix + ".bim").filter(F.length(F.trim("value")) > 0)
    variants = bim.count()
    size, head = _bed_size(spark, prefix + ".bed")
    if head != MAGIC:
        raise ValueError(f"{prefix}.bed: not a variant-major bed file")
    if size != 3 + variants * width:
        raise ValueError(f"{prefix}.bed: {size} bytes; {variants} variants of {n} samples take {3 + variants * width}")
    by_contig, strict, bed = _by_contig(regions), cfg.strict_compat, prefix + ".bed"

    def parse(seq: int, cols: list[str], raw: bytes):
        contig, name, pos, a1, a2 = cols[0], cols[1], int(cols[3]), cols[4].upper(), cols[5].upper()
        line = "\t".join((contig, name, "0", cols[3], a1, a2))
        if any(len(x) != 1 or x not in "ACGT" for x in (a1, a2)):
            yield from ((g, contig, pos, seq, rank, None, None, None, None, None, "indel", line) for g, _ in groups)
            return
        for label in _labels(by_contig, contig, pos, strict):
            a, b = unpack_bed(raw, n)
            for g, pick in groups:
                x, y = (a, b) if pick is None else (a[pick], b[pick])
                yield _row(g, label, pos, seq, rank, len(x), encode(x, y, cfg, "plink"), line)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(bed.removeprefix("file://"), "rb") as f:
            for batch in batches:
                out = []
                for value, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    f.seek(3 + seq * width)
                    out += [r if keep_lines else (*r[:-1], None) for r in parse(seq, value.split(), f.read(width))]
                cols = zip(*out, strict=True) if out else [[]] * len(_NAMES)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], _NAMES)

    return bim.select("value", "seq").mapInArrow(run, SCHEMA)


def _bed_size(spark: SparkSession, path: str) -> tuple[int, bytes]:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.open(p)
    try:
        return fs.getFileStatus(p).getLen(), bytes(b & 0xFF for b in (stream.read(), stream.read(), stream.read()))
    finally:
        stream.close()


# --- PED/MAP -------------------------------------------------------------------------------------------

#: Bases of numeric allele codes.
BASES = {"1": "A", "2": "C", "3": "G", "4": "T", "0": "-"}


def merged_alleles(a: str, b: str) -> str:
    """Two PED alleles as a genotype code: missing with a base gives the base, two bases their code, or both
    letters where there is none."""
    from .encoding import HET_CODE

    a, b = BASES.get(a, a).upper(), BASES.get(b, b).upper()
    if a == b or b == "-":
        return a
    if a == "-":
        return b
    return HET_CODE.get(frozenset((a, b)), a + b)


def ped_to_genotype(spark: SparkSession, ped: str, map_file: str) -> DataFrame:
    """Genotype lines (contig, pos, seq, codes) from PED/MAP: allele pairs are taken apart by marker, joined
    with the MAP by its index and put together by sample; the position is the last MAP column without sign."""
    markers = lines_of(spark, map_file).filter(F.length(F.trim("value")) > 0).select("seq", F.split(F.trim("value"), r"\s+").alias("m"))
    markers = markers.select(F.col("seq").cast("int").alias("marker"), F.get("m", F.lit(0)).alias("contig"), F.abs(F.element_at("m", -1).cast("long")).alias("pos"))
    merge = F.udf(lambda cols: [merged_alleles(cols[k], cols[k + 1]) for k in range(6, len(cols) - 1, 2)], "array<string>", useArrow=True)
    samples = lines_of(spark, ped).filter(F.length(F.trim("value")) > 0).select("seq", F.posexplode(merge(F.split(F.trim("value"), r"\s+"))).alias("marker", "code"))
    rows = samples.groupBy("marker").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "code"))), lambda s: s["code"]).alias("codes"))
    return rows.join(markers, "marker").select("contig", "pos", F.col("marker").cast("long").alias("seq"), "codes")


def write_genotype(rows: DataFrame, path: str) -> None:
    """One text file a partition, in order of the markers."""
    line = F.concat_ws("\t", "contig", F.col("pos").cast("string"), F.concat_ws(" ", "codes"))
    rows.repartitionByRange("seq").sortWithinPartitions("seq").select(line).write.text(path)


# --- lists ---------------------------------------------------------------------------------------------


def label_of(path: str) -> str:
    name = os.path.basename(path)
    return "".join(c if c.isalnum() or c in "._-" else "_" for c in name)


def sample_groups(paths: tuple[str, ...]) -> list[tuple[str, list[str]]]:
    """(label, names) of sample lists. A file whose every line has two columns gives groups by the second, in
    order of appearance; any other is one group of all its names, named by the file, or '' for a single list."""
    groups: dict[str, list[str]] = {}
    for path in paths:
        with open(path) as f:
            rows = [line.split() for line in f if line.strip() and not line.startswith("#")]
        if rows and all(len(r) == 2 for r in rows):
            for name, label in rows:
                groups.setdefault(label_of(label), []).append(name)
        else:
            groups.setdefault("" if len(paths) == 1 else label_of(path), []).extend(n for r in rows for n in r)
    return list(groups.items())


def resolve(groups: list[tuple[str, list[str]]], names: list[str]) -> Groups:
    """Groups as indices in header order; a name twice in the header counts twice. Fewer than 3 is an error."""
    out: Groups = []
    for label, wanted in groups:
        want = set(wanted)
        picked = [k for k, n in enumerate(names) if n in want]
        if len(picked) < 3:
            raise ValueError(f"group {label or 'of the list'}: {len(picked)} samples found; 3 are needed")
        out.append((label, picked))
    return out


def panel_groups(panel: DataFrame, sample: str = "sample", group: str = "super_pop") -> DataFrame:
    """(sample, group) of a panel table."""
    return panel.select(F.col(sample).alias("sample"), F.col(group).alias("group"))
