"""Hybrid retrieval and the retrieval benchmark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgscreen.functions.text import normalise
from msgscreen.operators.dense import dense_topk, index_size_mb
from msgscreen.operators.embed import Encoder
from msgscreen.operators.fusion import RRF_K, rrf_fuse
from msgscreen.operators.keyed import keyed_topk
from msgscreen.operators.lexical import LexicalIndex, bm25_topk
from msgscreen.operators.retrieval_eval import mean_metrics, query_metrics
from msgscreen.operators.sampling import SEED, simple_sample

# Width of the two candidate lists, final list, knowledge list, sample size.
CANDIDATES = 20
FINAL = 5
KNOWLEDGE = 3
SAMPLE = 100


def _vector_bytes(encoder: Encoder, rows: int | None) -> int | None:
    """Bound of a query matrix when its row count and dimension are known beforehand."""
    dim = getattr(encoder, "dim", None)
    return None if dim is None or rows is None else rows * (dim * 8 + 16)


def hybrid_search(
    queries: DataFrame,
    index: LexicalIndex,
    vectors: DataFrame,
    encoder: Encoder,
    *,
    k: int = FINAL,
    candidates: int = CANDIDATES,
    constant: int = RRF_K,
    pad: bool = False,
    text: str = "text",
    query_rows: int | None = None,
) -> DataFrame:
    """``(query_id, doc_id, rank, rrf_score, source)`` for a table of queries.

    ``query_rows`` is the counted number of queries, where the caller has it already.
    """
    query_rows = queries.count() if query_rows is None else query_rows
    clean = queries.select("query_id", normalise(F.col(text)).alias("text"))
    encoded = encoder.encode(clean, "text", keep=["query_id"])
    dense = dense_topk(encoded, vectors, candidates, query_bytes=_vector_bytes(encoder, query_rows))
    lexical = bm25_topk(clean, index, candidates, pad=pad)
    return rrf_fuse([dense, lexical], k, constant)


def knowledge_search(
    queries: DataFrame,
    chunks: DataFrame,
    encoder: Encoder,
    *,
    k: int = KNOWLEDGE,
    normalised: bool = False,
    text: str = "text",
    query_rows: int | None = None,
) -> DataFrame:
    """``(query_id, rank, score, source_name, chunk_id, chunk)``: best chunks per query.

    ``chunks(source_name, chunk_id, chunk, embedding)`` as a knowledge base stores them; they are neither encoded nor
    read twice. The query text is encoded as it is unless ``normalised``. An empty table gives an empty result. Equal
    scores rank by name and number.
    """
    value = normalise(F.col(text)) if normalised else F.col(text)
    query_rows = queries.count() if query_rows is None else query_rows
    encoded = encoder.encode(queries.select("query_id", value.alias("text")), "text", keep=["query_id"])
    found = keyed_topk(encoded, chunks, k, ["source_name", "chunk_id"], ["chunk"], query_bytes=_vector_bytes(encoder, query_rows))
    return found.select("query_id", "rank", "score", "source_name", "chunk_id", "chunk")


def knn_leave_one_out(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Neighbours of rows of the corpus itself; the own row is dropped before ranking."""
    return dense_topk(queries, vectors, k, exclude_self=True)


def retrieval_benchmark(
    corpora: dict[str, DataFrame],
    *,
    k: int = FINAL,
    sample_size: int | None = SAMPLE,
    seed: int = SEED,
    exclude_self: bool = False,
) -> DataFrame:
    """One row per model: dimension, index size and mean retrieval metrics.

    ``corpora`` maps a model name to ``(doc_id, embedding, label)``. The queries are a
    seeded sample of rows (all rows with ``sample_size=None``), searched with their own row
    left out. A model without labelled rows gets NULL metrics.
    """
    rows, metrics = [], []
    for model, corpus in corpora.items():
        drawn = corpus if sample_size is None else simple_sample(corpus, sample_size, "doc_id", seed)
        queries = drawn.select(F.col("doc_id").alias("query_id"), "embedding", "label")
        run = knn_leave_one_out(queries, corpus, k)
        bound = None if sample_size is None else sample_size * k
        per_query = query_metrics(
            run, queries.select("query_id", "label"), corpus.select("doc_id", "label"), k,
            exclude_self=exclude_self, row_bound=bound,
        )
        metrics.append(per_query.withColumn("model", F.lit(model)))
        rows.append(index_size_mb(corpus).withColumn("model", F.lit(model)))
    sizes = reduce(DataFrame.unionByName, rows)
    means = mean_metrics(reduce(DataFrame.unionByName, metrics))
    return sizes.join(means, "model", "left")
