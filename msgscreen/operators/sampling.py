"""Reproducible samples: rows are ordered by a hash of seed and id, so any engine draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from msgscreen.scale import broadcast_bounded, top_rows

# Fixed value: seed of every draw.
SEED = 42


def draw_key(id_col: str, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def simple_sample(df: DataFrame, n: int, id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """min(n, rows) rows. Each task keeps n, so nothing but n rows per task moves."""
    return df.withColumn("_key", draw_key(id_col, seed)).orderBy("_key", id_col).limit(n).drop("_key")


def head(df: DataFrame, n: int, key: str) -> DataFrame:
    """First n rows by an explicit key; each task keeps n."""
    return df.orderBy(key).limit(n)


#: Up to here Spark cuts a ranked group to n rows in each task; larger draws go by a threshold.
RANKED_ROWS = 1000
#: Hash digits (base 16) of a threshold: a class is counted in so many to the power of 16 ranges.
DIGITS = 4


def stratified_sample(
    df: DataFrame, n: int, by: str = "label", id_col: str = "doc_id", seed: int = SEED
) -> DataFrame:
    """Up to n rows per class, those with the lowest hashes; a short class gives all it has."""
    if n > RANKED_ROWS:
        return threshold_sample(df, n, by, id_col, seed)
    keyed = df.where(F.col(by).isNotNull()).withColumn("_key", draw_key(id_col, seed))
    return top_rows(keyed, [by], [F.asc("_key"), F.asc(id_col)], n).drop("_key", "rank")


def threshold_sample(
    df: DataFrame, n: int, by: str = "label", id_col: str = "doc_id", seed: int = SEED, digits: int = DIGITS
) -> DataFrame:
    """The rows of ``stratified_sample`` for any n: one aggregate finds each class's threshold, a filter keeps what lies below.

    Hashes are counted by their first ``digits``; rows of lower ranges than the one that holds the n-th hash are in, and only
    that one range of a class (a 65536th of it) is ranked.
    """
    keyed = df.where(F.col(by).isNotNull()).withColumn("_key", draw_key(id_col, seed)).withColumn("_range", F.left("_key", F.lit(digits)))
    upwards = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = keyed.groupBy(by, "_range").agg(F.count("*").alias("_n")).withColumn("_sum", F.sum("_n").over(upwards))
    reached = F.col("_sum") >= n
    edges = counted.groupBy(by).agg(
        F.min(F.when(reached, F.col("_range"))).alias("_edge"), F.coalesce(F.max(F.when(~reached, F.col("_sum"))), F.lit(0)).alias("_below")
    )
    classes = edges.count()
    placed = keyed.join(broadcast_bounded(edges, classes), by)
    inside = placed.where(F.col("_edge").isNull() | (F.col("_range") < F.col("_edge"))).select(*df.columns)
    ranked = placed.where(F.col("_range") == F.col("_edge"))
    order = Window.partitionBy(by).orderBy("_key", id_col)
    last = ranked.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n - F.col("_below")).select(*df.columns)
    return inside.unionByName(last)


def short_classes(df: DataFrame, n: int, by: str = "label") -> DataFrame:
    """Classes with fewer than n rows."""
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("rows")).where(F.col("rows") < n)
