"""Readers and writers of the plain tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from msgscreen import schema
from msgscreen.functions.text import normalise
from msgscreen.scale import path_exists


def load_corpus(
    spark: SparkSession, path: str, fmt: str = "parquet", header_row: int = 0, text_column: str = "norm_text",
    multi_line: bool = True,
) -> DataFrame:
    """Labelled corpus with an explicit schema; rows without normalised text are dropped.

    For CSV, ``header_row=1`` reads files whose column names stand in the second record; the record
    above them is skipped. Exactly these two are left out: any other row whose ``doc_id`` is not a
    number fails the read. Rows keep their ``doc_id``. ``multi_line`` allows line breaks inside quotes,
    at the price of one task per file.
    """
    reader = spark.read.schema(schema.CORPUS)
    if fmt == "csv":
        reader = reader.option("multiLine", multi_line).option("escape", '"').option("mode", "FAILFAST")
        if header_row == 0:
            df = reader.option("header", True).option("enforceSchema", False).csv(path)
        else:
            # Every column is read as text so that the preamble and header survive to be filtered.
            names = schema.CORPUS.fieldNames()
            texts = T.StructType([T.StructField(n, T.StringType(), True) for n in names])
            # ``header`` drops the first record of each file, here the preamble; the names are found by equality.
            raw = spark.read.schema(texts).option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
            named = reduce(and_, [F.col(n).eqNullSafe(F.lit(n)) for n in names])
            df = raw.where(~named).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    else:
        df = reader.format(fmt).load(path)
    return df.na.drop(subset=[text_column])


def with_norm_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("norm_text", normalise(F.col(text)))


def read_or_empty(
    spark: SparkSession, path: str, table_schema: T.StructType, tolerant: bool = False
) -> DataFrame:
    """The parquet table at ``path``, or an empty frame of its schema when there is none.

    ``tolerant`` skips unreadable files, for which Spark logs a warning, instead of failing.
    """
    if path_exists(spark, path):
        return spark.read.schema(table_schema).option("ignoreCorruptFiles", tolerant).parquet(path)
    return spark.createDataFrame([], table_schema)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Reports as CSV with a header."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def clear_history(spark: SparkSession, path: str, confirm: bool = False) -> None:
    """Replace the analysis log by an empty one; refuses without ``confirm=True``."""
    if not confirm:
        raise ValueError("clearing the history needs confirm=True")
    write_table(spark.createDataFrame([], schema.ANALYSIS_LOG), path)
