"""Tables written to the shared checkpoint folder, to cut the lineage of iterative plans.

A spooled table is Parquet under the folder that ``spark.checkpoint.dir`` names, so the loss of an
executor loses nothing, and columns stay prunable.  Only on a local master without the setting (tests, a
laptop) is a folder of our own made; on a cluster that would be another folder on every machine.

Spark knows a table only by the compressed size of its files, and would broadcast what fills the driver once
unpacked and exploded.  So a table that is not small by its bytes and by its rows asks for sort-merge joins.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of files, and rows, up to which Spark may broadcast a spooled table, or what is made of it.
SMALL_BYTES, SMALL_ROWS = 256 << 10, 50_000

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only for a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own:
        folder = tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[context.applicationId] = "file://" + folder
    return _own[context.applicationId]


class Spool:
    """The spooled tables of one run of an operator; those no longer needed are dropped by name."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.serial = 0

    def _folder(self, path: str):
        """(file system, path) of Hadoop."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return it as read back, with ``spool_path`` and ``spool_rows``: its rows, or -1 for more than a few."""
        self.serial += 1
        path = f"{self.root}/{self.serial}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        files, at = self._folder(path)
        rows = out.count() if files.getContentSummary(at).getLength() <= SMALL_BYTES else -1
        if not 0 <= rows <= SMALL_ROWS:
            out, rows = out.hint("merge"), -1
            # Spark keeps the shuffle files of a finished plan until the driver collects its garbage.
            self.spark._jvm.System.gc()
        out.spool_path, out.spool_rows = path, rows
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for df in frames:
            files, at = self._folder(df.spool_path)
            files.delete(at, True)

    def clear(self) -> None:
        """Delete all of its tables, once the result that reads them is written."""
        files, at = self._folder(self.root)
        files.delete(at, True)
