"""Result files. Rows are formatted in Python, where %.4f rounds the binary value as C does; a file appears
under its name only when it is complete. Small results are streamed from the ordered DataFrame. Pair tables and
filtered inputs, which are large, are formatted and compressed by the executors as ordered parts in the shared folder, and
one file of them is the parts one after the other; no row goes through Spark to the driver. Pair tables are also offered as partitioned
Parquet."""

from __future__ import annotations

import contextlib
import gzip
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import shared_folder, ship

BINS_HEADER = "#Dist\tMean_r^2\tMean_D'\tSum_r^2\tSum_D'\tNumberPairs\n"
#: Headers and columns of the pair tables by output type.
PAIR_HEADERS = {3: "#chr\tSite1\tSite2\tr^2\tDist\n", 6: "#chr\tSite1\tSite2\tD'\tr^2\tDist\n", 7: "#chr\tSite1\tSite2\tD'\tLOD\tr^2\tDist\n",
                8: "#chr\tSite1\tSite2\tD'\tLOD\tr^2\tCIlow\tCIhi\tDist\n"}
_PAIR_COLUMNS = {3: ("rr",), 6: ("d", "rr"), 7: ("d", "lod", "rr"), 8: ("d", "lod", "rr", "low", "high")}


def stat_prefix(path: str) -> str:
    """An output name without .gz and .stat."""
    return path.removesuffix(".gz").removesuffix(".stat")


def group_prefix(prefix: str, label: str) -> str:
    return f"{prefix}.{label}" if label else prefix


@contextlib.contextmanager
def _file(path: str) -> Iterator:
    part = f"{path}.part"
    try:
        with gzip.open(part, "wt", newline="") as f:
            yield f
        os.replace(part, path)
    finally:
        with contextlib.suppress(FileNotFoundError):
            os.remove(part)


def _4(x: float | None) -> str:
    return "NA" if x is None else f"{x:.4f}"


def write_bins(bins: DataFrame, path: str) -> None:
    with _file(path) as f:
        f.write(BINS_HEADER)
        for r in bins.orderBy("dist").toLocalIterator():
            f.write(f"{r['dist']}\t{_4(r['mean_rr'])}\t{_4(r['mean_d'])}\t{_4(r['sum_rr'])}\t{_4(r['sum_d'])}\t{r['n']}\n")


def write_histogram(hist: DataFrame, path: str, out_type: int, n_hap: int) -> None:
    with _file(path) as f:
        f.write("#Dist\tR^2\tR^2_count\tD'\tD_count\n" if out_type == 4 else "#Dist\tR^2\tR^2_count\n")
        f.write(f"#2SampleSize\t{n_hap}\n")
        for r in hist.orderBy("dist", "bucket").toLocalIterator():
            v = f"{r['bucket'] / 100:.2f}"
            f.write(f"{r['dist']}\t{v}\t{r['n_rr']}" + (f"\t{v}\t{r['n_d']}" if out_type == 4 else "") + "\n")


def pair_line(r: dict, out_type: int) -> str:
    cols = [f"{r[c] / 100:.2f}" if c in ("low", "high") else f"{r[c]:.4f}" for c in _PAIR_COLUMNS[out_type]]
    return "\t".join((r["contig"], str(r["p1"]), str(r["p2"]), *cols, str(r["dist"])))


def pair_lines(values: DataFrame, out_type: int) -> DataFrame:
    """The lines of a pair table as `value`, in order."""
    ship(values.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pair_line(r, out_type) for r in batch.to_pylist()], pa.string())], ["value"])

    return values.select("contig", "p1", "p2", *_PAIR_COLUMNS[out_type], "dist").orderBy("contig", "p1", "p2").mapInArrow(run, "value string")


def write_parts(lines: DataFrame, path: str) -> None:
    """A folder of gzipped text files, ordered by name as lines are, in the folder that driver and executors share."""
    lines.write.text(path, compression="gzip")


def write_one(lines: DataFrame, path: str, head: str = "") -> None:
    """One gzipped text file: the head and the parts, a gzip member each, which are copied as they are."""
    spark = lines.sparkSession
    write_parts(lines, folder := f"{shared_folder(spark)}/parts-{uuid.uuid4().hex}")
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    target, part = os.path.abspath(path), os.path.abspath(f"{path}.part")
    try:
        with gzip.open(part, "wb") as f:
            f.write(head.encode())
        out = spark._jvm.java.io.FileOutputStream(part, True)
        try:
            for p in sorted((s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName()):
                source = fs.open(p)
                try:
                    spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, spark._jsc.hadoopConfiguration(), False)
                finally:
                    source.close()
        finally:
            out.close()
        os.replace(part, target)
    finally:
        fs.delete(at, True)
        with contextlib.suppress(FileNotFoundError):
            os.remove(part)


def write_pairs(values: DataFrame, path: str, out_type: int) -> None:
    """One ordered text file."""
    write_one(pair_lines(values, out_type), path, PAIR_HEADERS[out_type])


def write_pairs_parquet(values: DataFrame, path: str) -> None:
    """Ordered ranges by contig, written in parallel."""
    values.repartitionByRange("contig", "p1").sortWithinPartitions("contig", "p1", "p2").write.partitionBy("contig").parquet(path)


def write_ehh(rows: DataFrame, path: str) -> None:
    found = rows.orderBy("pos").collect()  # one window around one core
    with _file(path) as f:
        if found:
            f.write(f"#Chr\tSite\tDist\tEHH_all\tEHH_0\tEHH_1\n#SNP_Number\t{len(found)}\n")
        for r in found:
            f.write(f"{r['contig']}\t{r['pos']}\t{r['dist']}\t{r['ehh_all']:.4f}\t{r['ehh_0']:.4f}\t{r['ehh_1']:.4f}\n")


def write_filtered(sites: DataFrame, path: str, header: list[str] = ()) -> None:
    """Input lines of kept sites, as they are and in order; a header makes the file readable again."""
    lines = sites.filter("reason IS NULL").select("seq", "line").distinct().orderBy("seq").select(F.col("line").alias("value"))
    write_one(lines, path, "".join(h + "\n" for h in header))


def write_mean_bins(rows: DataFrame, path: str) -> None:
    with _file(path) as f:
        f.write(BINS_HEADER)
        for r in rows.orderBy("is_long", "bin_end").toLocalIterator():
            f.write("\t".join(str(r["bin_end"]) if c is None else "NA" if r[c] is None else repr(r[c]) for c in (None, "mean_rr", "mean_d", "sum_rr", "sum_d")) + f"\t{r['n']}\n")


def write_curve(rows: DataFrame, path: str) -> None:
    """x and value of a summary, short bins before long ones where it has both."""
    keys = [c for c in ("is_long", "x") if c in rows.columns]
    with _file(path) as f:
        for r in rows.orderBy(*keys).toLocalIterator():
            f.write(f"{r['x']}\t{r['value']!r}\n")


def haploview_rows(calls: DataFrame, bases: tuple[str, str] = ("A", "C")) -> DataFrame:
    """(sample_idx, hap, alleles): two rows a sample, its alleles by position as bases, 0 where missing."""
    base = lambda c: F.when(F.col("miss"), "0").when(F.col(c) == "0", bases[0]).when(F.col(c) == "1", bases[1]).otherwise(F.col(c))
    sides = F.array(F.struct(F.lit(1).alias("hap"), base("a").alias("x")), F.struct(F.lit(2).alias("hap"), base("b").alias("x")))
    long = calls.select("sample_idx", "pos", F.explode(sides).alias("s"))
    return long.groupBy("sample_idx", F.col("s.hap").alias("hap")).agg(
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("pos", "s.x"))), lambda v: v["x"])).alias("alleles")
    )
