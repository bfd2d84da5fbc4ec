"""Retrieval metrics. A retrieved row is relevant when it has the label of the query."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgscreen.scale import broadcast_bounded


def relevant_counts(doc_labels: DataFrame) -> DataFrame:
    """``(label, n_relevant)``: corpus rows per label, counted once for all queries."""
    return doc_labels.where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n_relevant"))


def query_metrics(
    run: DataFrame,
    query_labels: DataFrame,
    doc_labels: DataFrame,
    k: int = 5,
    *,
    exclude_self: bool = False,
    row_bound: int | None = None,
) -> DataFrame:
    """``(query_id, precision, recall, hit, rr, ndcg)`` of every labelled query.

    Queries without results score 0. The relevant count includes the query's own row
    unless ``exclude_self``. ``row_bound`` (queries * k) lets the run be broadcast to the
    corpus labels.
    """
    labelled = query_labels.where("label IS NOT NULL").join(
        relevant_counts(doc_labels), "label", "left"
    ).select(
        "query_id", "label",
        (F.coalesce("n_relevant", F.lit(0)) - F.lit(1 if exclude_self else 0)).alias("n_relevant"),
    )
    side = run.select("query_id", "doc_id", "rank")
    side = side if row_bound is None else broadcast_bounded(side, row_bound)
    found = doc_labels.select("doc_id", F.col("label").alias("doc_label")).join(side, "doc_id")
    relevant = F.coalesce(F.col("doc_label") == F.col("label"), F.lit(False))
    top = F.col("rank") <= k
    per_query = (
        labelled.join(found, "query_id", "left")
        .groupBy("query_id")
        .agg(
            F.first("n_relevant").alias("n_relevant"),
            F.count_if(top).alias("top"),
            F.count_if(top & relevant).alias("found"),
            F.min(F.when(relevant, F.col("rank"))).alias("first"),
            F.sum(F.when(top & relevant, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
        )
    )
    ideal, total = [], 0.0
    for rank in range(1, k + 1):
        total += 1.0 / math.log2(rank + 1)
        ideal.append(F.lit(total))
    best = F.get(F.array(*ideal), (F.least(F.col("n_relevant"), F.lit(k)) - 1).cast("int"))
    hits = F.col("found").cast("double")
    return per_query.select(
        "query_id",
        F.when(F.col("top") > 0, hits / F.col("top")).otherwise(0.0).alias("precision"),
        F.when(F.col("n_relevant") > 0, hits / F.col("n_relevant")).otherwise(0.0).alias("recall"),
        F.when(F.col("found") > 0, 1.0).otherwise(0.0).alias("hit"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"),
        F.coalesce(F.col("dcg") / best, F.lit(0.0)).alias("ndcg"),
    )


def mean_metrics(metrics: DataFrame, by: list[str] = ("model",), digits: int = 4) -> DataFrame:
    """Means over queries; NULL where a model has no labelled query."""
    names = {"precision": "precision", "recall": "recall", "hit": "hit_rate", "rr": "mrr", "ndcg": "ndcg"}
    return metrics.groupBy(*by).agg(
        F.count("query_id").alias("queries"),
        # Rounding the mean at 12 digits first removes the order of summation.
        *[F.bround(F.round(F.avg(old), 12), digits).alias(new) for old, new in names.items()],
    )
