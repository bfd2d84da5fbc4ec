"""The document registry as a snapshot and the log behind it.

``log/sink=<name>/version=<n>`` holds the operations of each batch; ``snapshots/<n>`` holds the newest row of every name
(``rows``, deletes included) and which log folders it has taken in (``covered``, written last). A snapshot without
the success mark of ``covered`` does not exist: a job that breaks off leaves the state before. Reading costs the
snapshot and the folders after it, however many versions there were; covered folders are deleted by ``vacuum`` once a
newer snapshot stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgscreen import schema
from msgscreen.operators import registry
from msgscreen.scale import child_names, path_exists, remove

_COVERED = "folder string"


def append(log_rows: DataFrame, path: str, version: int, sink: str = "batch") -> None:
    """Append the operations of one batch; a replay replaces itself."""
    log_rows.select(*schema.REGISTRY_LOG.fieldNames()).write.mode("overwrite").parquet(f"{path}/log/sink={sink}/version={version}")


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Complete log folders, by name."""
    found = [f"{s}/{v}" for s in child_names(spark, f"{path}/log") for v in child_names(spark, f"{path}/log/{s}") if v.startswith("version=")]
    return sorted(f for f in found if path_exists(spark, f"{path}/log/{f}/_SUCCESS"))


def snapshots(spark: SparkSession, path: str) -> list[int]:
    found = sorted(int(n) for n in child_names(spark, f"{path}/snapshots") if n.isdigit())
    return [n for n in found if path_exists(spark, f"{path}/snapshots/{n}/covered/_SUCCESS")]


def _state(spark: SparkSession, path: str) -> tuple[DataFrame | None, set[str]]:
    """Rows of the newest snapshot, and the folders it covers that are still there."""
    known = snapshots(spark, path)
    if not known:
        return None, set()
    home = f"{path}/snapshots/{known[-1]}"
    covered = {r["folder"] for r in spark.read.schema(_COVERED).parquet(f"{home}/covered").collect()}  # names of folders
    return spark.read.schema(schema.REGISTRY_LOG).parquet(f"{home}/rows"), covered


def load(spark: SparkSession, path: str) -> DataFrame:
    """The operation log as far as it matters: the snapshot and what came after it. ``registry`` views apply."""
    rows, covered = _state(spark, path)
    fresh = [f"{path}/log/{f}" for f in _folders(spark, path) if f not in covered]
    if fresh:
        log = spark.read.schema(schema.REGISTRY_LOG).option("recursiveFileLookup", True).parquet(*fresh)
        rows = log if rows is None else rows.unionByName(log)
    return spark.createDataFrame([], schema.REGISTRY_LOG) if rows is None else rows


def compact(spark: SparkSession, path: str) -> int:
    """Write a new snapshot; returns its number."""
    number = max(snapshots(spark, path), default=0) + 1
    folders = _folders(spark, path)  # listed before the rows are read: what arrives meanwhile stays in the log
    rows, covered = _state(spark, path)
    fresh = [f for f in folders if f not in covered]
    if fresh:
        log = spark.read.schema(schema.REGISTRY_LOG).option("recursiveFileLookup", True).parquet(*[f"{path}/log/{f}" for f in fresh])
        rows = log if rows is None else rows.unionByName(log)
    rows = spark.createDataFrame([], schema.REGISTRY_LOG) if rows is None else rows
    home = f"{path}/snapshots/{number}"
    registry.latest(rows).select(*schema.REGISTRY_LOG.fieldNames()).write.mode("overwrite").parquet(f"{home}/rows")
    spark.createDataFrame([(f,) for f in folders], _COVERED).coalesce(1).write.mode("overwrite").parquet(f"{home}/covered")
    return number


def vacuum(spark: SparkSession, path: str) -> None:
    """Delete the log folders that the newest snapshot covers, and older snapshots."""
    known = snapshots(spark, path)
    if not known:
        return
    _, covered = _state(spark, path)
    for folder in sorted(covered & set(_folders(spark, path))):
        remove(spark, f"{path}/log/{folder}")
    for n in known[:-1]:
        remove(spark, f"{path}/snapshots/{n}")


def status(spark: SparkSession, path: str) -> DataFrame:
    return registry.status(load(spark, path)).withColumn("n", F.col("n").cast("bigint"))
