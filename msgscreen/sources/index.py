"""Stored retrieval artefacts, reused only while they match the corpus."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgscreen import schema
from msgscreen.operators.embed import Encoder
from msgscreen.operators.fusion import case_part
from msgscreen.operators.lexical import (
    LexicalIndex,
    build_doc_terms,
    idf_of,
    length_stats,
    posting_blocks,
    postings_in,
)
from msgscreen.scale import path_exists, remove, scratch_path


def fingerprint(docs: DataFrame, text: str = "text") -> str:
    """Row count and order-free hash sum of ids and texts; one row comes back."""
    # Decimal sums cannot overflow the way 64-bit sums of hashes do.
    row = docs.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("doc_id", text).cast("decimal(20,0)")).alias("h"),
    ).first()
    return f"{row['n']}_{abs(int(row['h'] or 0)):x}"


def file_fingerprint(files: DataFrame) -> str:
    """Hash of paths, sizes and change times of the files behind a plain file scan.

    Reads no data columns, so it suits corpora too large to be hashed at every start.
    """
    meta = files.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    row = meta.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*meta.columns).cast("decimal(20,0)")).alias("h")).first()
    return f"f{row['n']}_{abs(int(row['h'] or 0)):x}"


def encoder_mark(encoder: Encoder, name: str | None = None) -> str:
    """Folder name of an encoder: its class and parameters, and the id that the user gives it.

    A callable among the parameters is known by its qualified name only, so a user model should
    come with a ``name`` that changes with the model.
    """

    def shown(value) -> str:
        return f"{value.__module__}.{value.__qualname__}" if callable(value) else repr(value)

    kind = type(encoder)
    fields = sorted(getattr(encoder, "__dict__", {}).items())
    text = f"{kind.__module__}.{kind.__qualname__}({', '.join(f'{k}={shown(v)}' for k, v in fields)}){name or ''}"
    return f"{name or kind.__name__}-{hashlib.md5(text.encode()).hexdigest()[:12]}"


def save_lexical_index(docs: DataFrame, path: str, text: str = "text") -> None:
    """Write the index tables. Texts are tokenised once; the rest derives from the stored counts.

    ``posting_blocks`` is ranged by (term, first document): a query reads few files, and a stop word that
    touches most documents spreads over many files instead of filling one. A row holds a list of postings, so
    the shuffle sorts lists, and the document frequencies are sums of their lengths.
    """
    spark = docs.sparkSession
    build_doc_terms(docs, text).write.mode("overwrite").parquet(f"{path}/doc_terms")
    doc_terms = spark.read.schema(schema.DOC_TERMS).parquet(f"{path}/doc_terms")
    save_posting_blocks(doc_terms, f"{path}/posting_blocks")
    blocks = spark.read.schema(schema.POSTING_BLOCKS).parquet(f"{path}/posting_blocks")
    lengths = length_stats(doc_terms)
    term_stats, _ = idf_of(blocks.groupBy("term").agg(F.sum("n").alias("df")), lengths.select("n").scalar())
    term_stats.write.mode("overwrite").parquet(f"{path}/term_stats")
    # The mean of the raw idf needs no second pass over documents: df and n give it back.
    stored = spark.read.schema(schema.TERM_STATS).parquet(f"{path}/term_stats")
    n = lengths.select("n").scalar()
    df = F.col("df").cast("double")
    mean = stored.select((F.ln(n - df + 0.5) - F.ln(df + 0.5)).alias("raw")).agg(F.avg("raw"))
    lengths.withColumn("avg_idf", mean.scalar()).write.mode("overwrite").parquet(f"{path}/corpus_stats")


def save_posting_blocks(doc_terms: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """``posting_blocks`` ranged by (term, first document), formed once although ranging reads its input twice."""
    spark, scratch = doc_terms.sparkSession, scratch_path(doc_terms.sparkSession, "postings")
    rows = posting_blocks(doc_terms, by)
    rows.write.parquet(scratch)
    formed = spark.read.schema(rows.schema).parquet(scratch)
    formed.repartitionByRange("term", "first").sortWithinPartitions("term", "first").write.mode("overwrite").parquet(path)
    remove(spark, scratch)


def load_lexical_index(spark: SparkSession, path: str) -> LexicalIndex:
    def table(name: str, table_schema) -> DataFrame:
        return spark.read.schema(table_schema).parquet(f"{path}/{name}")

    return LexicalIndex(
        table("doc_terms", schema.DOC_TERMS),
        postings_in(table("posting_blocks", schema.POSTING_BLOCKS)),
        table("term_stats", schema.TERM_STATS),
        table("corpus_stats", schema.CORPUS_STATS),
        stored=True,
    )


def build_retrieval_system(
    docs: DataFrame,
    path: str,
    encoder: Encoder,
    *,
    text: str = "text",
    encoder_name: str | None = None,
    mark: str | None = None,
    force_rebuild: bool = False,
) -> tuple[LexicalIndex, DataFrame]:
    """Lexical index and vectors of ``docs(doc_id, text)``, built unless already stored.

    Artefacts live under a folder named by the corpus fingerprint, so those of another
    corpus are never picked up; each part counts as stored once its success mark exists.
    ``mark`` replaces the content fingerprint, e.g. by ``file_fingerprint``. Vectors are kept per
    encoder (``encoder_mark``), and their dimension is compared with the encoder's on load.
    """
    spark = docs.sparkSession
    home = f"{path}/{mark or fingerprint(docs, text)}"
    lexical, vectors = f"{home}/lexical", f"{home}/vectors/{encoder_mark(encoder, encoder_name)}"
    # Indexes of before ``posting_blocks`` have their postings one by one; they are built anew.
    whole = all(path_exists(spark, f"{lexical}/{name}/_SUCCESS") for name in ("posting_blocks", "corpus_stats"))
    if force_rebuild or not whole:
        save_lexical_index(docs, lexical, text)
    if force_rebuild or not path_exists(spark, f"{vectors}/_SUCCESS"):
        encoder.encode(docs.select("doc_id", text), text, keep=["doc_id"]).write.mode("overwrite").parquet(vectors)
    kept = spark.read.schema(schema.VECTORS).parquet(vectors)
    first, dim = kept.select(F.size("embedding")).first(), getattr(encoder, "dim", None)
    if first is not None and dim is not None and first[0] != dim:
        raise ValueError(f"stored vectors at {vectors} have {first[0]} dimensions, the encoder gives {dim}")
    return load_lexical_index(spark, lexical), kept


def save_cases(corpus: DataFrame, path: str, parts: int) -> None:
    """Case table of ``parts`` folders by a hash of the id, from which ``gather`` reads only what it needs."""
    placed = corpus.withColumn("part", case_part(F.col("doc_id"), parts))
    placed.repartition(F.col("part")).write.mode("overwrite").partitionBy("part").parquet(path)


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
