"""Reciprocal rank fusion, gathering of winners, lists of similar cases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgscreen.scale import broadcast_bounded, top_rows

#: Fixed value: constant of reciprocal rank fusion.
RRF_K = 60

CASE_FIELDS = ["text", "label", "language", "attack_type", "risk_level", "channel"]


def rrf_fuse(runs: list[DataFrame], k: int = 5, constant: int = RRF_K) -> DataFrame:
    """Fuse ranked lists: score = sum of ``1 / (constant + rank)``.

    Ties keep first-seen order: position in the earliest list that holds the row.
    """
    lists = [
        run.select("query_id", "doc_id", "rank", F.lit(i).alias("list_no")) for i, run in enumerate(runs)
    ]
    fused = (
        reduce(DataFrame.unionByName, lists)
        .groupBy("query_id", "doc_id")
        .agg(
            F.sum(F.lit(1.0) / (F.lit(constant) + F.col("rank"))).alias("_sum"),
            F.min(F.col("list_no").cast("bigint") * F.lit(1 << 32) + F.col("rank")).alias("_seen"),
        )
        # Twelve digits: the order in which a sum was formed must not decide a rank.
        .withColumn("rrf_score", F.round("_sum", 12))
    )
    ranked = top_rows(fused, ["query_id"], [F.desc("rrf_score"), F.asc("_seen")], k)
    return ranked.select(
        "query_id", "doc_id", "rank", "rrf_score", F.lit("hybrid_rrf").alias("source")
    )


def case_part(doc_id: Column, parts: int) -> Column:
    """Folder of a case in a case table of so many folders."""
    return F.pmod(F.xxhash64(doc_id), F.lit(parts)).cast("int")


def gather(run: DataFrame, corpus: DataFrame, row_bound: int | None = None, parts: int | None = None) -> DataFrame:
    """Corpus columns of every ranked row.

    With ``row_bound`` (queries * k) proven small, the run is broadcast and the corpus
    is neither shuffled nor sorted; otherwise Spark joins on ``doc_id``. From a case table
    (``save_cases`` with ``parts`` folders) only the folders that hold a winner are read.
    """
    if parts is None:
        return corpus.join(run if row_bound is None else broadcast_bounded(run, row_bound), "doc_id")
    keyed = run.where("rank > 0").withColumn("part", case_part(F.col("doc_id"), parts))
    keyed = keyed if row_bound is None else broadcast_bounded(keyed, row_bound)
    return corpus.join(keyed, ["part", "doc_id"]).drop("part")


def similar_cases(gathered: DataFrame, fields: list[str] = CASE_FIELDS) -> DataFrame:
    """One row per query with its cases as an array in rank order (at most k each)."""
    return (
        gathered.groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", *fields))).alias("_cases"))
        .select(
            "query_id",
            F.transform(
                "_cases", lambda c: F.struct(*[c[name].alias(name) for name in fields])
            ).alias("similar_cases"),
            F.size("_cases").alias("retrieved_examples"),
        )
    )
