"""Session-wide services: the shared folder, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of a side that may be broadcast; beyond it joins shuffle.
BROADCAST_LIMIT_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing, a temporary folder serves a local session; a cluster session
    without it is refused, because a machine-local folder would be lost with its machine.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + os.path.join(tempfile.gettempdir(), f"voxmill-{os.getpid()}")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


_OPEN: dict[str, SparkSession] = {}


def delete_workspaces(spark: SparkSession) -> None:
    """Delete all workspaces of this driver; results that were not stored yet can't be read afterwards."""
    for root in list(_OPEN):
        if _OPEN[root].sparkContext is spark.sparkContext:
            del _OPEN[root]
            delete(spark, root)


def _at_exit() -> None:
    for spark in {id(s.sparkContext): s for s in _OPEN.values()}.values():
        try:
            delete_workspaces(spark)
        except Exception:  # noqa: BLE001 - the session may have ended; its folder is then left to its owner
            pass


class Workspace:
    """A private sub-folder of the shared folder, holding the tables that cut lineage.

    A result may read from it until it is used, so it lives until ``delete_workspaces`` is called, or the driver ends.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        if not _OPEN:
            atexit.register(_at_exit)
        _OPEN[self.root] = spark

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        """Write ``df`` and read it back: later stages neither recompute it nor carry its lineage."""
        self._n += 1
        at = self.path(f"{name}-{self._n:03d}")
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._voxmill_path = at
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table made by ``save`` that nothing reads any more."""
        at = getattr(df, "_voxmill_path", None)
        if at:
            delete(self.spark, at)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def is_file(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast ``df`` only if ``rows * row_bytes`` is proven to stay under the limit."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_LIMIT_BYTES else df


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application, unless PYTHONPATH has it."""
    import pathlib
    import zipfile

    home = pathlib.Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if app in _SHIPPED or str(home.parent) in on_path:
        return
    at = os.path.join(tempfile.mkdtemp(), "voxmill.zip")
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    spark.sparkContext.addPyFile(at)
    _SHIPPED.add(app)
