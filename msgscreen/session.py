"""Session settings the plans rely on; everything else is the cluster's business."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    app: str = "msgscreen", master: str | None = None, shared_folder: str | None = None, **extra: str
) -> SparkSession:
    """``shared_folder`` is where intermediate tables go; every executor must see it."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    folder = {"spark.checkpoint.dir": shared_folder} if shared_folder else {}
    for key, value in {**SETTINGS, **folder, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
