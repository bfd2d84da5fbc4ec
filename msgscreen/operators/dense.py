"""Exact inner-product top-k.

Two plans with the same result:

* ``broadcast``: the query matrix, measured first, goes to every executor; the
  vectors are scanned once and never shuffled.
* ``fragments``: for a query side beyond the broadcast bound. Vectors are hashed by
  id into fragments of bounded bytes, queries into blocks; a task streams one block of
  queries past one fragment, and the tasks' best rows are merged in levels.

In both, a task returns at most k rows per query; pairs are never written out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgscreen.operators.blocks import best_k, running_best
from msgscreen.scale import BROADCAST_BYTES, block_count, block_pairs, measured_bytes, merged_best

#: Bytes of vectors held by one fragment while its queries stream past.
FRAGMENT_BYTES = 128 << 20

#: Products (query, vector) of one task of a scan and of one pair of blocks, about.
SCAN_PAIRS = 500_000_000
BLOCK_PAIRS = 4_000_000_000
#: Vectors that one task of a file scan may hold without being counted.
SCAN_ROWS = 100_000

_RUN_SCHEMA = "query_id bigint, doc_id bigint, score double"


def _matrix():
    """Arrow list column -> float64 matrix."""

    def matrix(column):
        import numpy as np
        import pyarrow as pa

        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        n = len(column)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.astype("float64").reshape(n, -1) if n else np.zeros((0, 0))

    return matrix


def _scan_with_broadcast(queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    spark = corpus.sparkSession
    table = queries.toArrow()  # bounded: the caller measured it
    matrix = _matrix()
    tasks = math.ceil(table.num_rows * corpus.count() / SCAN_PAIRS) if table.num_rows * SCAN_ROWS > SCAN_PAIRS else 1
    if tasks > 1:  # many products over few files
        corpus = corpus.repartition(tasks)
    shared = spark.sparkContext.broadcast(
        (table["query_id"].to_numpy(), matrix(table["embedding"]))
    )
    collect = running_best(k)

    def scan(batches: Iterator) -> Iterator:
        import numpy as np

        q_ids, q = shared.value
        add, results = collect(q_ids)
        for batch in batches:
            if not batch.num_rows or not len(q_ids):
                continue
            ids, vectors = batch["doc_id"].to_numpy(), matrix(batch["embedding"])
            step = max(1, (1 << 22) // len(ids))
            for at in range(0, len(q_ids), step):
                scores = q[at : at + step] @ vectors.T
                if exclude_self:
                    scores[q_ids[at : at + step, None] == ids[None, :]] = -np.inf
                add(at, ids, scores)
        yield from results()

    return corpus.mapInArrow(scan, _RUN_SCHEMA)


def score_fragments(
    queries: DataFrame, corpus: DataFrame, k: int, fragments: int, exclude_self: bool = False
) -> DataFrame:
    """Per-fragment best k. Both sides carry an integer ``frag`` below ``fragments``.

    One shuffle by ``frag``; inside a partition the vectors of a fragment come first
    and are held, then its queries stream past in Arrow batches.
    """
    both = corpus.select("frag", F.lit(0).alias("side"), F.col("doc_id").alias("id"), "embedding").unionByName(
        queries.select("frag", F.lit(1).alias("side"), F.col("query_id").alias("id"), "embedding")
    )
    ordered = both.repartitionById(fragments, F.col("frag")).sortWithinPartitions("frag", "side")
    matrix = _matrix()
    best = best_k(k)

    def stream(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        current, ids, blocks, block = None, [], [], None
        for batch in batches:
            frag = batch["frag"].to_numpy()
            side = batch["side"].to_numpy()
            edges = np.flatnonzero((np.diff(frag) != 0) | (np.diff(side) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(frag)]):
                if lo == hi:
                    continue
                if frag[lo] != current:
                    current, ids, blocks, block = frag[lo], [], [], None
                part_ids = batch["id"].slice(lo, hi - lo).to_numpy()
                part = matrix(batch["embedding"].slice(lo, hi - lo))
                if side[lo] == 0:
                    ids.append(part_ids)
                    blocks.append(part)
                    continue
                if block is None:
                    if not blocks:
                        continue
                    block = (np.concatenate(ids), np.concatenate(blocks))
                    ids, blocks = [], []
                step = max(1, (1 << 22) // len(block[0]))
                for at in range(0, len(part_ids), step):
                    scores = part[at : at + step] @ block[1].T
                    if exclude_self:
                        scores[part_ids[at : at + step, None] == block[0][None, :]] = -np.inf
                    rows, docs, top = best(block[0], scores)
                    yield pa.record_batch(
                        [pa.array(part_ids[rows + at]), pa.array(docs), pa.array(top)],
                        names=["query_id", "doc_id", "score"],
                    )

    return ordered.mapInArrow(stream, _RUN_SCHEMA)


def fragment_count(corpus: DataFrame, bytes_each: int = FRAGMENT_BYTES) -> int:
    """From the row count and one vector; the vectors are not read for it."""
    first = corpus.select(F.size("embedding")).first()
    return 1 if first is None else max(1, math.ceil(corpus.count() * (first[0] * 8 + 16) / bytes_each))


def dense_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 20,
    *,
    exclude_self: bool = False,
    plan: str = "auto",
    fragments: int | None = None,
    blocks: int | None = None,
    query_bytes: int | None = None,
) -> DataFrame:
    """``(query_id, doc_id, rank, score)``: the k largest inner products per query.

    ``queries(query_id, embedding)``, ``corpus(doc_id, embedding)``. Scores are rounded
    to 6 digits before ranking; ties go to the lower ``doc_id``. ``exclude_self`` drops
    pairs with equal ids before ranking. ``query_bytes`` is a proven bound of the query
    side (rows * dimension * 8); without it the side is measured.
    """
    queries = queries.select("query_id", "embedding")
    corpus = corpus.select("doc_id", "embedding")
    size = query_bytes
    if size is None and (plan == "auto" or plan == "fragments" and blocks is None):
        size = measured_bytes(queries)
    if plan == "auto":
        plan = "broadcast" if size <= BROADCAST_BYTES else "fragments"
    tasks = 1
    if plan == "broadcast":
        partial = _scan_with_broadcast(queries, corpus, k, exclude_self)
    elif plan == "fragments":
        count, per = fragments or fragment_count(corpus), blocks or block_count(size)
        if fragments is None:
            count = max(count, math.ceil(queries.count() * corpus.count() / (per * BLOCK_PAIRS)))
        tasks = count * per
        partial = score_fragments(*block_pairs(queries, corpus, count, per), k, tasks, exclude_self)
    else:
        raise ValueError(f"unknown plan {plan!r}")
    return merged_best(partial, k, tasks)


def index_size_mb(vectors: DataFrame, by: list[str] = ()) -> DataFrame:
    """Rows, dimension and size of the float32 matrix in MB."""
    return vectors.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.max(F.size("embedding")).cast("bigint").alias("dim"),
        F.round(F.sum(F.size("embedding")) * 4 / F.lit(1048576.0), 2).alias("index_size_mb"),
    )
