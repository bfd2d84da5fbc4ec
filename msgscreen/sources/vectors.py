"""Vectors by content: a text is encoded once, whatever documents and runs it occurs in.

``<store>/<encoder mark>/run=<n>`` holds ``(digest, embedding)``; the digest is of the text as the encoder gets it. A run
encodes the distinct texts whose digest is in no earlier run. A run that breaks off has no success mark and is not
read; the next one takes its number. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from msgscreen.operators.embed import Encoder
from msgscreen.schema import VECTOR
from msgscreen.scale import child_names, path_exists, remove
from msgscreen.sources.index import encoder_mark

_STORED = T.StructType([T.StructField("digest", T.StringType()), T.StructField("embedding", VECTOR)])


def text_digest(text: Column) -> Column:
    """Null texts count as empty, as encoders take them."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _runs(spark: SparkSession, home: str) -> list[str]:
    return [f"{home}/{c}" for c in sorted(child_names(spark, home)) if c.startswith("run=") and path_exists(spark, f"{home}/{c}/_SUCCESS")]


def stored_vectors(spark: SparkSession, home: str) -> DataFrame:
    runs = _runs(spark, home)
    return spark.read.schema(_STORED).option("recursiveFileLookup", True).parquet(*runs) if runs else spark.createDataFrame([], _STORED)


def encode_once(
    df: DataFrame, encoder: Encoder, store: str, text: str = "text", out: str = "embedding", encoder_name: str | None = None
) -> DataFrame:
    """``df`` with ``out``: stored vectors where the text is known to the store, new ones (stored as well) for the rest."""
    spark = df.sparkSession
    home = f"{store}/{encoder_mark(encoder, encoder_name)}"
    asked = df.withColumn("_digest", text_digest(F.col(text)))
    # Distinct digests first: the texts themselves only move where they are new.
    known = stored_vectors(spark, home).select(F.col("digest").alias("_digest"))
    texts = asked.select("_digest", F.coalesce(text, F.lit("")).alias("text")).join(known, "_digest", "left_anti").dropDuplicates(["_digest"])
    number = len(_runs(spark, home))
    while path_exists(spark, f"{home}/run={number}/_SUCCESS"):
        number += 1
    fresh = encoder.encode(texts.select(F.col("_digest").alias("digest"), "text"), "text", "embedding", keep=["digest"])
    fresh.write.mode("overwrite").parquet(f"{home}/run={number}")
    if spark.read.schema(_STORED).parquet(f"{home}/run={number}").isEmpty():
        remove(spark, f"{home}/run={number}")
    vectors = stored_vectors(spark, home).select(F.col("digest").alias("_digest"), F.col("embedding").alias(out))
    return asked.join(vectors, "_digest", "left").drop("_digest")
