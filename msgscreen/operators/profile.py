"""Corpus profile from one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Labels and languages that are always reported, with display names.
LABELS = ["phishing", "legitimate"]
LANGUAGES = {"en": "English", "ar": "Arabic", "fr": "French"}

DIMENSIONS = ["label", "channel", "language", "attack_type"]


def count_by(df: DataFrame, column: str) -> DataFrame:
    """Counts of the non-null values of a column, largest first."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "value")
    )


def fixed_counts(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Counts of fixed values, zeros kept."""
    counted = df.agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])
    return counted.unpivot([], values, "value", "n")


def language_counts(df: DataFrame) -> DataFrame:
    named = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return fixed_counts(df, "language", list(LANGUAGES)).select(
        F.element_at(named, F.col("value")).alias("language"), "n"
    )


def corpus_profile(df: DataFrame) -> DataFrame:
    """``(dimension, value, n)``: total, labels, channels, languages and attack types.

    Grouping sets share one scan; counts combine before the shuffle, so hot values cost
    one row per task. Fixed labels and languages with no rows appear with 0.
    """
    columns = [F.col(c) for c in DIMENSIONS]
    sets = df.groupingSets([[], *[[c] for c in columns]], *columns).agg(
        F.count("*").alias("n"), F.grouping_id().alias("_set")
    )
    # grouping_id has one bit per column, set where the column is rolled up.
    every = (1 << len(DIMENSIONS)) - 1
    dimension, value = F.lit("total"), F.lit("all")
    for i, name in enumerate(DIMENSIONS):
        only = every & ~(1 << (len(DIMENSIONS) - 1 - i))
        dimension = F.when(F.col("_set") == only, name).otherwise(dimension)
        value = F.when(F.col("_set") == only, F.col(name)).otherwise(value)
    counted = sets.select(dimension.alias("dimension"), value.alias("value"), "n").where("value IS NOT NULL")
    fixed = [("label", v) for v in LABELS] + [("language", v) for v in LANGUAGES]
    known = F.inline(
        F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(v).alias("value"), F.lit(0).cast("bigint").alias("n")) for d, v in fixed])
    )
    zeros = df.sparkSession.range(1).select(known)
    merged = counted.unionByName(zeros).groupBy("dimension", "value").agg(F.max("n").alias("n"))
    # Labels and languages outside the fixed sets are not part of the profile.
    allowed = (
        F.when(F.col("dimension") == "label", F.col("value").isin(LABELS))
        .when(F.col("dimension") == "language", F.col("value").isin(list(LANGUAGES)))
        .otherwise(True)
    )
    return merged.where(allowed)
