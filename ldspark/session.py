"""What a Spark application needs once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_FOLDERS: dict[str, str] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, whatever their PYTHONPATH holds; once an application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="ldspark-")  # executors fetch it when they start
        atexit.register(shutil.rmtree, folder, True)
        context.addPyFile(shutil.make_archive(f"{folder}/{package.name}-{uuid.uuid4().hex}", "zip", package.parent, package.name))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder of the application in the one that driver and executors share (spark.checkpoint.dir), deleted when
    the application ends; a temporary one only in local mode without that setting."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not top:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            top = tempfile.mkdtemp(prefix="ldspark-")
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{top}/files-{uuid.uuid4().hex}")
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _FOLDERS[app] = p.toString()
    return _FOLDERS[app]
