"""Document registry and analysis history as append-only logs with views on top."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgscreen.functions.text import preview
from msgscreen.scale import top_rows

# Lengths of the two previews.
HISTORY_PREVIEW = 80
CASE_PREVIEW = 120


def latest(log: DataFrame) -> DataFrame:
    """Newest row per name. The group limit runs before the shuffle, so a hot name is cheap."""
    return top_rows(log, ["name"], [F.desc("added_at"), F.desc("seq")], 1).drop("rank")


def active(log: DataFrame) -> DataFrame:
    """Newest row per name whose last operation is not a delete."""
    return latest(log).where(F.col("op") != "delete")


def listing(log: DataFrame) -> DataFrame:
    """Active documents with defaults for missing fields and a formatted date."""
    return active(log).select(
        F.coalesce("name", F.lit("Unknown")).alias("name"),
        F.coalesce("pages", F.lit(0).cast("bigint")).alias("pages"),
        F.coalesce(F.date_format("added_at", "yyyy-MM-dd HH:mm:ss"), F.lit("Unknown")).alias("added_date"),
        F.coalesce("path", F.lit("")).alias("path"),
    )


def upsert_rows(added: DataFrame) -> DataFrame:
    """Log rows for new or re-added documents ``(name, pages, added_at, path, seq)``."""
    return added.select("name", "pages", "added_at", "path", F.lit("upsert").alias("op"), "seq")


def delete_rows(log: DataFrame, requests: DataFrame) -> DataFrame:
    """Outcome of delete requests ``(name, requested_at, seq)``.

    ``found`` rows are the tombstones to append; the others name unknown documents.
    """
    known = active(log).select("name", "pages", "path")
    return requests.join(known.withColumn("found", F.lit(True)), "name", "left").select(
        "name",
        "pages",
        F.col("requested_at").alias("added_at"),
        "path",
        F.lit("delete").alias("op"),
        "seq",
        F.coalesce("found", F.lit(False)).alias("found"),
    )


def visible_chunks(chunks: DataFrame, log: DataFrame) -> DataFrame:
    """Chunks whose document is not deleted. Names are unique on the right, so rows stay whole."""
    gone = latest(log).where(F.col("op") == "delete").select(F.col("name").alias("source_name"))
    return chunks.join(gone, "source_name", "left_anti")


def status(log: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """``(dimension, value, n)``: number of active documents, then the corpus profile if given."""
    documents = active(log).agg(F.count("*").alias("n")).select(
        F.lit("documents").alias("dimension"), F.lit("active").alias("value"), "n"
    )
    return documents if profile is None else documents.unionByName(profile)


def history(log: DataFrame, width: int = HISTORY_PREVIEW) -> DataFrame:
    """Analyses newest first with previews."""
    return log.select(
        "ts", "seq", "label", "risk_level", preview(F.col("text"), width).alias("preview")
    ).orderBy(F.desc("ts"), F.desc("seq"))
