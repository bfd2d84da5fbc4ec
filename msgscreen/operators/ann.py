"""Approximate top-k: k-means cells, the nearest cells of each query, exact scores inside.

An option for corpora where an exact scan is too dear; recall against the exact
operator is reported by ``recall_against``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgscreen.operators.dense import score_fragments
from msgscreen.scale import BROADCAST_BYTES, measured_bytes, top_rows

#: Vectors held by one fragment of a cell; larger cells are split by a hash of the id.
CELL_ROWS = 100_000


def _with_nearest(df: DataFrame, ident: str, centroids, count: int) -> DataFrame:
    """``(ident, embedding, cells)``: the ``count`` nearest centroids of each vector, nearest first."""

    def nearest(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        lengths = (centroids**2).sum(axis=1)[None, :]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = batch["embedding"].flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(n, -1)
            order = np.argsort(lengths - 2.0 * v @ centroids.T, axis=1, kind="stable")[:, :count].astype("int32")
            cells = pa.ListArray.from_arrays(
                pa.array(np.arange(n + 1, dtype="int32") * order.shape[1]), pa.array(order.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [batch[ident], batch["embedding"], cells], [ident, "embedding", "cells"]
            )

    return df.select(ident, "embedding").mapInArrow(
        nearest, f"{ident} bigint, embedding array<float>, cells array<int>"
    )


@dataclass(frozen=True)
class CellIndex:
    vectors: DataFrame  # doc_id, embedding, cell
    centroids: object  # cells x dim; its size is set by the caller, not by the data


def build_cells(
    corpus: DataFrame, cells: int = 16, seed: int = 42, iterations: int = 10, fit_on: DataFrame | None = None
) -> CellIndex:
    """Fit cells and assign every vector of the corpus to its nearest one.

    ``fit_on`` may name fewer vectors to place the centroids by; it changes the layout of
    the cells, never which vectors are searchable.
    """
    import numpy as np

    features = (corpus if fit_on is None else fit_on).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=iterations).fit(features)
    centroids = np.array(model.clusterCenters())
    vectors = _with_nearest(corpus, "doc_id", centroids, 1).select(
        "doc_id", "embedding", F.col("cells")[0].alias("cell")
    )
    return CellIndex(vectors, centroids)


def cells_of(corpus: DataFrame, centroids: DataFrame) -> CellIndex:
    """Cells around given centroids ``(cell, embedding)``, numbered in the order of ``cell``.

    The table is bounded by its number of cells; it is measured before it is fetched.
    """
    import numpy as np

    size = measured_bytes(centroids)
    if size > BROADCAST_BYTES:
        raise ValueError(f"{size} bytes of centroids; at most {BROADCAST_BYTES} are sent to every task")
    rows = centroids.orderBy("cell").select(F.col("embedding").cast("array<double>").alias("v")).collect()
    places = np.array([r["v"] for r in rows])
    vectors = _with_nearest(corpus, "doc_id", places, 1).select("doc_id", "embedding", F.col("cells")[0].alias("cell"))
    return CellIndex(vectors, places)


def ann_topk(
    queries: DataFrame, index: CellIndex, k: int = 20, probes: int = 4, exclude_self: bool = False
) -> DataFrame:
    """``(query_id, doc_id, rank, score)`` among the ``probes`` nearest cells of each query.

    A cell of more than ``CELL_ROWS`` vectors is split into sub-fragments that its queries
    all visit, so one crowded cell is shared by many tasks.
    """
    sizes = index.vectors.groupBy("cell").agg(F.count("*").alias("rows"))
    # One row per cell comes back: numbering of (cell, split) pairs.
    split_of = {r["cell"]: max(1, -(-r["rows"] // CELL_ROWS)) for r in sizes.collect()}
    first, at = [], 0
    for cell in range(len(index.centroids)):
        first.append(at)
        at += split_of.get(cell, 1)
    starts = F.array(*[F.lit(x) for x in first])
    splits = F.array(*[F.lit(int(split_of.get(c, 1))) for c in range(len(index.centroids))])
    cell = F.col("cell")
    placed = index.vectors.withColumn(
        "frag", (F.get(starts, cell) + F.pmod(F.xxhash64("doc_id"), F.get(splits, cell))).cast("int")
    )
    probing = _with_nearest(queries, "query_id", index.centroids, probes).select(
        "query_id", "embedding", F.explode("cells").alias("cell")
    ).select(
        "query_id",
        "embedding",
        F.explode(
            F.sequence(F.get(starts, cell), F.get(starts, cell) + F.get(splits, cell) - 1)
        ).alias("frag"),
    )
    partial = score_fragments(probing, placed, k, at, exclude_self)
    return top_rows(partial, ["query_id"], [F.desc("score"), F.asc("doc_id")], k).select(
        "query_id", "doc_id", "rank", "score"
    )


def recall_against(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact list that the approximate list contains, per query."""
    found = approximate.select("query_id", "doc_id", F.lit(1).alias("found"))
    return (
        exact.join(found, ["query_id", "doc_id"], "left")
        .groupBy("query_id")
        .agg((F.count("found") / F.count("*")).alias("recall"))
    )
