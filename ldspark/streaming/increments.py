"""Growing inputs: bins are sums, so new sites only need their pairs with what is there.

A stream of sites (contig by contig in any order) is joined batch by batch: new with new, and new with the
stored sites within the largest distance. Each batch's bins are a table of their own, so a batch that is
run again replaces its own result and nothing counts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import distance_bins, merge_bins
from ..operators.pairs import pair_tables, pair_values


def batch_bins(new: DataFrame, old: DataFrame | None, max_dist: int, out_type: int = 1, n_hap: int | None = None) -> DataFrame:
    """Bins of the pairs with at least one site of `new`: new with new, new before old and old before new. Pairs of
    two old sites are never made."""
    tables = pair_tables(new, max_dist, n_hap)
    if old is not None:
        tables = tables.unionByName(pair_tables(new, max_dist, n_hap, behind=old)).unionByName(pair_tables(old, max_dist, n_hap, behind=new))
    return distance_bins(pair_values(tables, out_type), out_type)


class DecayStream:
    """The folder of a growing analysis: sites/ and bins/ by batch."""

    def __init__(self, folder: str, max_dist: int, out_type: int = 1, n_hap: int | None = None):
        self.folder, self.max_dist, self.out_type, self.n_hap = folder, max_dist, out_type, n_hap

    def add(self, new: DataFrame, batch: int) -> None:
        """For foreachBatch. Sites at stored positions are dropped: the first stays."""
        spark = new.sparkSession
        old = None
        if batch_paths := [f"{self.folder}/sites/{b}" for b in self._batches(spark) if b != batch]:
            old = spark.read.parquet(*batch_paths)
            new = new.join(old.select("grp", "contig", "pos"), ["grp", "contig", "pos"], "left_anti")
        new = new.dropDuplicates(["grp", "contig", "pos"])
        new.write.mode("overwrite").parquet(f"{self.folder}/sites/{batch}")
        new = spark.read.parquet(f"{self.folder}/sites/{batch}")
        batch_bins(new, old, self.max_dist, self.out_type, self.n_hap).write.mode("overwrite").parquet(f"{self.folder}/bins/{batch}")

    def start(self, sites: DataFrame):
        return sites.writeStream.foreachBatch(self.add).option("checkpointLocation", f"{self.folder}/progress").trigger(availableNow=True).start()

    def bins(self, spark) -> DataFrame:
        return merge_bins(spark.read.parquet(*[f"{self.folder}/bins/{b}" for b in self._batches(spark)]))

    def _batches(self, spark) -> list[int]:
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/sites")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit())
