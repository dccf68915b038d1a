"""Tables in the shared folder, which cut lineage and outlast executors."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: With this setting a query's shuffle files are removed when it ends, not when the driver collects garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@functools.cache
def _own_folder() -> str:
    """A temporary folder of this process, for sessions on one machine alone; it goes when the process ends."""
    path = tempfile.mkdtemp(prefix="lexforge-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


#: Most bytes of an Arrow batch between the JVM and Python.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession | None = None, size: int = BATCH_BYTES) -> None:
    """Arrow batches of at most ``size`` bytes in this session: both the JVM and its Python workers hold a
    batch at a time, and rows here are whole texts, or blocks of many. A smaller setting stays."""
    spark = spark or SparkSession.active()
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None) or "64m"
    digits = "".join(c for c in now if c.isdigit())
    unit = {"k": 10, "m": 20, "g": 30}.get(now.lower().removesuffix("b")[-1:], 0)
    if int(digits or 0) << unit > size or now.startswith("-"):
        spark.conf.set(name, str(size))


class Workspace:
    """A folder below ``spark.checkpoint.dir`` for tables that cut lineage.

    The folder is the cluster's shared one. A session on one machine that names none
    (tests) gets a temporary folder, and its settings stay as they are; on a cluster that is
    an error. Written tables survive the loss of executors.
    """

    def __init__(self, spark: SparkSession, label: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            base = _own_folder()
        self.spark = spark
        self.root = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
        folder, fs = self._hadoop(self.root)
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)  # when the application ends; until then plans may read it

    def _hadoop(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def local(self, name: str) -> str:
        """The same folder as a POSIX path, for files that workers memory-map."""
        path = self.path(name)
        if path.startswith("file:"):
            return "/" + path[len("file:"):].lstrip("/")
        if "://" in path:
            raise ValueError(f"memory-mapped files need a mounted spark.checkpoint.dir, not {path}")
        return path

    def stow(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back: lineage ends here, and its shuffles go with the write."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        conf, before = self.spark.conf, self.spark.conf.get(SHUFFLES_GO, None)
        conf.set(SHUFFLES_GO, "true")
        try:
            df.write.parquet(path)
        finally:
            conf.unset(SHUFFLES_GO) if before is None else conf.set(SHUFFLES_GO, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete a table made by ``stow`` that no later plan reads."""
        for file in df.inputFiles()[:1]:
            path, fs = self._hadoop(file)
            fs.delete(path.getParent(), True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: it is computed once, and the planner knows its size."""
    return Workspace(df.sparkSession, label).stow(df, label)
