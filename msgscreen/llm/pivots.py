"""Exact top-k by inner product with pivot-table elimination.

|q - x|**2 = |q|**2 + |x|**2 - 2 q.x, so a lower bound of the distance is an upper bound of the product.
Every vector gets its distances to ``PIVOTS`` pivots (a table computed once, in the scan). For a query the
triangle inequality gives max over pivots of |d(q, p) - d(x, p)| <= |q - x|. Candidates are evaluated in the
order of their bound and the search of a block stops when the next bound is below the k-th score found.

Queries and candidates are cut into blocks of at most ``QUERY_BLOCK`` and ``CANDIDATE_BLOCK`` rows by a hash
of the id; a task meets one query block with one candidate block and gives back k rows a query, which are
ranked with a group limit before the last shuffle. The queries are a stated set; neither side is collected
or broadcast whole. The pivots are rows with the lowest hashes, ``PIVOTS`` for each dimension.

Vectors that are null, empty or hold a null or non-finite component take no part, nor do rows without an
id; vectors only meet vectors of their own dimension. Rows that repeat an id are candidates each; a query
skips all rows of its own id; repeated query rows count once per distinct vector. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIVOTS = 16
QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 16384
#: Candidates evaluated between two looks at the bound.
STRIDE = 256

FOUND = "query_id bigint, query_row bigint, vec_id bigint, score bigint"


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine).select(
        F.col(key).cast("bigint").alias("vec_id"), v.cast("array<double>").alias("v")
    )


def scaled(v: Column, factor: float = 256.0) -> Column:
    """floor(factor * x) of each component, as whole numbers."""
    return F.transform(v, lambda x: F.floor(x.cast("double") * factor).cast("bigint"))


def _pivots(vectors: DataFrame, count: int) -> dict[int, np.ndarray]:
    """For each dimension ``count`` distinct vectors with the lowest hashes."""
    first = Window.partitionBy("dim").orderBy("h", "v")
    rows = (
        vectors.select(F.size("v").alias("dim"), F.xxhash64("v").alias("h"), "v")
        .groupBy("dim", "h").agg(F.min("v").alias("v"))
        .withColumn("n", F.row_number().over(first)).where(F.col("n") <= count).collect()
    )
    found: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["dim"], r["n"])):
        found.setdefault(r["dim"], []).append(r["v"])
    return {d: np.array(p, np.float64) for d, p in found.items()}


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2), 0))


def search(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, qd: np.ndarray, xd: np.ndarray, k: int):
    """For each query (row, id, score) of its k best candidates, ties to smaller ids."""
    exact = q.astype(np.int64), x.astype(np.int64)
    q2, x2 = (q * q).sum(axis=1), (x * x).sum(axis=1)
    for i in range(len(q)):
        low = np.abs(xd[:, 0] - qd[i, 0])
        for p in range(1, xd.shape[1]):
            np.maximum(low, np.abs(xd[:, p] - qd[i, p]), out=low)
        # Room for rounding: the bound may only be too high.
        bound = (q2[i] + x2 - low * low) / 2
        bound += 1e-9 * (q2[i] + x2) + 1
        bound[x_ids == q_ids[i]] = -np.inf
        order = np.argsort(-bound, kind="stable")
        best_s, best_i, at, floor = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, -np.inf
        while at < len(order) and bound[order[at]] > -np.inf and (len(best_s) < k or bound[order[at]] >= floor):
            part = order[at : at + STRIDE]
            part = part[bound[part] > -np.inf]
            s = np.concatenate((best_s, exact[1][part] @ exact[0][i]))
            ids = np.concatenate((best_i, x_ids[part]))
            keep = np.lexsort((ids, -s))[:k]
            best_s, best_i = s[keep], ids[keep]
            floor = best_s[-1] if len(best_s) == k else -np.inf
            at += STRIDE
        yield best_i, best_s


def topk(vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int = PIVOTS,
         query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score. Both inputs have ``vec_id`` and ``v`` (whole numbers as doubles or longs)."""
    both = [df.select("vec_id", F.col("v").cast("array<double>").alias("v")) for df in (queries.distinct(), vectors)]
    sizes = [df.count() for df in both]
    table = _pivots(both[1], pivots)
    held = {d: p.tobytes() for d, p in table.items()}
    n_q, n_x = max(1, -(-sizes[0] // query_block)), max(1, -(-sizes[1] // candidate_block))

    def with_distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            flat, ends = v.flatten().to_numpy(), v.offsets.to_numpy() - v.offsets[0].as_py()
            dims = np.diff(ends)
            out = np.empty(len(batch), object)
            for d in set(dims.tolist()):
                rows = np.flatnonzero(dims == d)
                x = flat[(ends[rows][:, None] + np.arange(d)).ravel()].reshape(-1, d)
                p = np.frombuffer(held[d]).reshape(-1, d) if d in held else np.zeros((1, d))
                for r, dist in zip(rows.tolist(), distances(x, p)):
                    out[r] = dist.tobytes()
            packed = [flat[ends[r] : ends[r + 1]].tobytes() for r in range(len(batch))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(dims, pa.int32()), pa.array(packed, pa.binary()), pa.array(list(out), pa.binary())],
                ["vec_id", "dim", "v", "d"],
            )

    schema = "vec_id bigint, dim int, v binary, d binary"
    q, x = (df.mapInArrow(with_distances, schema) for df in both)
    block = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.select("*", F.lit(True).alias("asks"), block(n_q).alias("qb"), F.xxhash64("v").alias("row")).withColumn("xb", every(n_x))
    x = x.select("*", F.lit(False).alias("asks"), block(n_x).alias("xb"), F.lit(0).cast("bigint").alias("row")).withColumn("qb", every(n_q))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        asks = rows.column("asks").to_numpy()
        ids, row = rows.column("vec_id").to_numpy(), rows.column("row").to_numpy()
        matrix = lambda c: np.frombuffer(b"".join(rows.column(c).to_pylist())).reshape(len(rows), -1)
        v, d = matrix("v"), matrix("d")
        out: list[list] = [[], [], [], []]
        at = np.flatnonzero(asks)
        for i, (best_i, best_s) in zip(at, search(v[asks], ids[asks], v[~asks], ids[~asks], d[asks], d[~asks], k)):
            for a, b in zip(best_i.tolist(), best_s.tolist()):
                for column, value in zip(out, (int(ids[i]), int(row[i]), a, b)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["query_id", "query_row", "vec_id", "score"])

    pairs = q.unionByName(x).groupBy("dim", "qb", "xb").applyInArrow(meet, FOUND)
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
