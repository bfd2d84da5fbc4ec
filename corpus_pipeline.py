"""Corpus pipeline: toxicity, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and is written as
Parquet in the shared folder and read again. All stages but the last return the columns of ``documents``.

* toxicity: documents scored 0.5 or more go.
* near_duplicates: of each component of linked documents the one with the smallest id stays (5 words,
  similarity 0.85; of rows that repeat an id one stays; rows without an id are linked with nothing and stay).
* decontamination: a document with a benchmark passage goes.
* secrets: every secret span is replaced by a mark; the document stays, ``n_chars`` follows.
* packing: pieces of sequences of 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgscreen.llm import bottomk, decontaminate, packing, secrets, toxicity
from msgscreen.llm.common import scratch
from msgscreen.llm.queries import table, toxicity_model


def _like(docs: DataFrame, result: DataFrame) -> DataFrame:
    return result.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.scored(docs, toxicity_model(spark, sf_dir, docs), out="__score")
    return _like(docs, scored.where(F.col("__score") < 0.5))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = bottomk.linked(docs).where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    named = left.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    return _like(docs, named.unionByName(left.where("doc_id IS NULL")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), out="__hits")
    return _like(docs, found.where(F.col("__hits.n_hit") == 0))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.masked(secrets.scanned(docs, out="__secrets"), secrets="__secrets")
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        clean = clean.withColumn("n_chars", F.when(F.size("__secrets.spans") > 0, length).otherwise(F.col("n_chars")))
    return _like(docs, clean)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: The classifier, the near-duplicate components and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
