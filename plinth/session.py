"""Session helpers: ship this package's code to the executors once per application."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_made: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, whatever their ``PYTHONPATH``."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="plinth-code-"), "plinth-code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where that is unset, a temporary one for a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        key = spark.sparkContext.applicationId
        found = _own.get(key) or _own.setdefault(key, "file://" + tempfile.mkdtemp(prefix="plinth-shared-"))
    return found.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through Hadoop's file system, wherever it lies."""
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may have ended; a scratch table may stay then
        pass


class Scratch:
    """Tables that cut lineage: ``keep(df, name)`` writes once and gives a DataFrame that reads it.

    ``files`` bounds the files of a table where its maker knows how much there is: on a local file system a writer
    starts a process or two for each. The writing tasks then take several partitions each; shuffles stay as they are.
    """

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark = spark
        self.files: int | None = None
        self.root = f"{shared_dir(spark)}/plinth-{label}-{uuid.uuid4().hex[:12]}"
        _made.append((spark, self.root))

    def keep(self, df: DataFrame, name: str, files: int | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        files = files or self.files
        (df.coalesce(files) if files else df).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        drop_path(self.spark, f"{self.root}/{name}")

    def close(self) -> None:
        """Delete every table of this scratch; results that read them must have been written."""
        drop_path(self.spark, self.root)
        _made[:] = [m for m in _made if m[1] != self.root]


@atexit.register
def _forget() -> None:
    for spark, root in _made:
        if spark.sparkContext._jsc is not None:
            drop_path(spark, root)
