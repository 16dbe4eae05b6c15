"""The index as Parquet snapshots: written beside each other, switched by one pointer file, read without re-parsing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, drop_path
from ..streaming.incremental import changed
from . import code


def current(spark: SparkSession, root: str) -> str | None:
    """The snapshot that the newest pointer names, None where there is none or it cannot be read."""
    try:
        row = spark.read.text(f"{root}/CURRENT.txt").select("value").first()
        return row[0] if row and spark.read.parquet(f"{root}/{row[0]}/files").limit(1) is not None else None
    except Exception:  # noqa: BLE001  a missing or broken snapshot means a fresh index
        return None


def refresh(spark: SparkSession, files: DataFrame, root: str, force: bool = False) -> dict[str, int]:
    """Bring the snapshot under ``root`` to ``files(file_path, content, mtime)``; parses only what changed."""
    listing = files.select(F.col("file_path").alias("path"), "mtime", "content")
    name = None if force else current(spark, root)
    if name:
        old_files, old_facts = spark.read.parquet(f"{root}/{name}/files"), spark.read.parquet(f"{root}/{name}/facts")
    else:
        old_files = spark.createDataFrame([], "path string, mtime timestamp, sha string")
        old_facts = None
    scratch = Scratch(spark, "refresh")
    fresh, touched, stale = (scratch.keep(part, n) for part, n in zip(changed(listing, old_files), ("fresh", "touched", "stale"), strict=True))
    facts = code.extract(fresh.select(F.col("path").alias("file_path"), "content"))
    if old_facts is not None:
        gone = fresh.select("path").union(stale.select("path"))
        facts = facts.unionByName(old_facts.join(gone.withColumnRenamed("path", "file_path"), "file_path", "left_anti"))
    kept = old_files.join(fresh.select("path").union(stale.select("path")).union(touched.select("path")), "path", "left_anti")
    state = kept.select("path", "mtime", "sha").unionByName(touched).unionByName(fresh.select("path", "mtime", "sha"))
    version = f"v-{uuid.uuid4().hex[:12]}"
    facts.write.parquet(f"{root}/{version}/facts")
    state.write.parquet(f"{root}/{version}/files")
    written = spark.read.parquet(f"{root}/{version}/facts")
    done = {"scanned": spark.read.parquet(f"{root}/{version}/files").count(), "reindexed": fresh.count(), "symbols_indexed": written.agg(F.sum(F.size("symbols"))).first()[0] or 0}
    _point(spark, root, version)
    _prune(spark, root, {version, name})
    scratch.close()
    return done


def _point(spark: SparkSession, root: str, version: str) -> None:
    """Write the pointer beside the old one and rename it over, in one step: there is always a pointer."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fresh, pointer = path(f"{root}/.next-{version}"), path(f"{root}/CURRENT.txt")
    stream = fresh.getFileSystem(conf).create(fresh, True)
    stream.write(version.encode())
    stream.close()
    mode = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(mode, 1)
    over[0] = mode.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), conf).rename(fresh, pointer, over)


def _prune(spark: SparkSession, root: str, kept: set[str | None]) -> None:
    """Drop snapshots but ``kept``: the new one, and the one before it, which readers may still be at."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    for found in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path):
        name = found.getPath().getName()
        if name.startswith("v-") and name not in kept:
            drop_path(spark, f"{root}/{name}")


def clean(spark: SparkSession, root: str) -> None:
    drop_path(spark, root)
