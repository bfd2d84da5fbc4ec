"""Stored approximate index: vectors by cell with product-quantised codes, exact scores for the finalists.

A store has a ``model`` (cell centroids, and for each slice of the dimensions a book of ``CODES`` residuals), fitted once on
at most ``FIT_ROWS`` vectors drawn by a hash, and ``rows/sink=<name>/version=<n>/cell=<c>``: every vector added, with its key
columns, in the folder of its cell, which is computed when it is added and never again. A batch that is added twice
under one name and version replaces itself. A search reads the codes of the probed cells only, ranks them by their
approximate products, and scores the ``refine`` * k best of a query exactly from the vectors of the same folders.

The model decides what is found quickly, not what can be found: with all cells probed and enough finalists the result is
the exact one. Vectors that are null or of another dimension than the model's are not stored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from msgscreen.operators.keyed import keyed_topk
from msgscreen.scale import BROADCAST_BYTES, broadcast_bounded, measured_bytes, path_exists, stored, top_rows

#: Vectors that the model is fitted on, at most.
FIT_ROWS = 20_000
CODES = 256
ITERATIONS = 12
PROBES = 4
REFINE = 20
#: Dimensions that one code stands for.
SLICE_WIDTH = 4

_MODEL = "part int, place int, vector array<double>"  # part -1: cell centroids; others: the book of a slice


@dataclass(frozen=True)
class CellModel:
    """Centroids (cells x dimension) and books (slices x codes x width); bounded by the parameters of the fit."""

    centroids: object
    books: object

    def nearest(self, vectors, count: int):
        """The nearest cells of each vector, nearest first."""
        import numpy as np

        far = (self.centroids**2).sum(axis=1)[None, :] - 2.0 * vectors @ self.centroids.T
        return np.argsort(far, axis=1, kind="stable")[:, :count]

    def codes(self, vectors, cells):
        import numpy as np

        slices, _, width = self.books.shape
        rest = vectors - self.centroids[cells]
        out = np.empty((len(vectors), slices), "uint8")
        for s in range(slices):
            part = rest[:, s * width : (s + 1) * width]
            out[:, s] = ((self.books[s] ** 2).sum(axis=1)[None, :] - 2.0 * part @ self.books[s].T).argmin(axis=1)
        return out

    def products(self, queries, cells, codes):
        """Approximate inner products (queries x rows)."""
        import numpy as np

        slices, _, width = self.books.shape
        total = (queries @ self.centroids.T)[:, cells]
        for s in range(slices):
            total += (queries[:, s * width : (s + 1) * width] @ self.books[s].T)[:, codes[:, s]]
        return np.ascontiguousarray(total)


def _matrix(column):
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), -1)


def _lloyd(points, count: int, seed: int):
    """Centroids of k-means; as many as there are distinct points, if these are fewer."""
    import numpy as np

    rng = np.random.default_rng(seed)
    points = points[np.lexsort(points.T)]  # the order of arrival does not matter
    start = np.unique(points, axis=0)
    centroids = start[rng.permutation(len(start))[:count]]
    for _ in range(ITERATIONS):
        owner = np.concatenate([
            ((centroids**2).sum(axis=1)[None, :] - 2.0 * points[a : a + 4096] @ centroids.T).argmin(axis=1) for a in range(0, len(points), 4096)
        ])
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, points)
        held = np.bincount(owner, minlength=len(centroids))
        centroids = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centroids)
    return centroids


def fit_cells(
    vectors: DataFrame, path: str, cells: int, slices: int | None = None, codes: int = CODES, fit_rows: int = FIT_ROWS, seed: int = 42
) -> CellModel:
    """Fit a model on ``vectors(embedding)`` and store it. Centroids in one task, then each slice's book in a task."""
    spark = vectors.sparkSession
    usable = vectors.where("embedding IS NOT NULL AND size(embedding) > 0").select("embedding")
    n = usable.count()
    if n == 0:
        raise ValueError("no vectors to fit cells on")
    draw = F.pmod(F.xxhash64("embedding", F.lit(seed)), F.lit(1 << 30))
    drawn = stored(usable.where(draw <= int((1 << 30) * min(1.0, 2 * fit_rows / n))).withColumn("draw", draw).orderBy("draw", "embedding").limit(fit_rows), "fit")

    def centroids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        found = _lloyd(np.concatenate([_matrix(b["embedding"]) for b in batches]), cells, seed)
        yield _model_rows(-1, found)

    one = drawn.withColumn("part", F.lit(-1)).groupBy("part").applyInArrow(centroids, _MODEL)
    places = _read_matrix(stored(one, "centroids"), -1)
    slices = slices or -(-places.shape[1] // SLICE_WIDTH)
    width = -(-places.shape[1] // slices)

    def book(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        rows = pa.Table.from_batches(list(batches))
        s, points = rows["part"][0].as_py(), _matrix(rows["embedding"].combine_chunks())
        owner = ((places**2).sum(axis=1)[None, :] - 2.0 * points @ places.T).argmin(axis=1)
        rest = (points - places[owner])[:, s * width : (s + 1) * width]
        found = _lloyd(np.pad(rest, ((0, 0), (0, width - rest.shape[1]))), codes, seed + s)
        yield _model_rows(s, np.concatenate((found, np.repeat(found[:1], codes - len(found), axis=0))))

    books = drawn.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).groupBy("part").applyInArrow(book, _MODEL)
    placed = [(-1, i, [float(x) for x in c]) for i, c in enumerate(places)]
    books.unionByName(spark.createDataFrame(placed, _MODEL)).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    return load_model(spark, path)


def _model_rows(part: int, matrix):
    n = len(matrix)
    return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([list(v) for v in matrix], pa.list_(pa.float64()))], ["part", "place", "vector"])


def _read_matrix(model: DataFrame, part: int):
    import numpy as np

    return np.array([r["vector"] for r in model.where(F.col("part") == part).orderBy("place").collect()])


def has_model(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, f"{path}/model/_SUCCESS")


def load_model(spark: SparkSession, path: str) -> CellModel:
    import numpy as np

    table = spark.read.schema(_MODEL).parquet(f"{path}/model")
    size = measured_bytes(table)
    if size > BROADCAST_BYTES:
        raise ValueError(f"a model of {size} bytes; at most {BROADCAST_BYTES} are sent to every task")
    slices = table.agg(F.max("part")).first()[0] + 1
    centroids, books = _read_matrix(table, -1), np.array([_read_matrix(table, s) for s in range(slices)])
    wide = slices * books.shape[2]  # the last slice is filled up with zeros
    return CellModel(np.pad(centroids, ((0, 0), (0, wide - centroids.shape[1]))), books)


def add_vectors(rows: DataFrame, path: str, version: int, sink: str = "batch") -> None:
    """Store one batch ``(key columns..., embedding)`` by cell. The work is that of the batch."""
    spark = rows.sparkSession
    model = load_model(spark, path)
    dim, wide = _dimension(spark, path), model.centroids.shape[1]
    names = rows.columns

    def place(batches: Iterator) -> Iterator:
        import numpy as np

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                vectors = np.pad(_matrix(part["embedding"]), ((0, 0), (0, wide - dim)))
                cells = model.nearest(vectors, 1)[:, 0]
                codes = [c.tobytes() for c in model.codes(vectors, cells)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(codes, pa.binary()), pa.array(cells, pa.int32())], [*names, "code", "cell"])

    kind = T.StructType([*rows.schema.fields, T.StructField("code", T.BinaryType()), T.StructField("cell", T.IntegerType())])
    placed = rows.where(F.size("embedding") == dim).mapInArrow(place, kind)
    placed.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows/sink={sink}/version={version}")


def _dimension(spark: SparkSession, path: str) -> int:
    return spark.read.schema(_MODEL).parquet(f"{path}/model").where("part = -1").select(F.size("vector")).first()[0]


def load_rows(spark: SparkSession, path: str, kind: T.StructType | None = None) -> DataFrame:
    """All stored rows, with ``sink``, ``version`` and ``cell``; filters on these drop whole folders."""
    reader = spark.read if kind is None else spark.read.schema(kind)
    return reader.option("basePath", f"{path}/rows").parquet(f"{path}/rows")


def cell_topk(
    queries: DataFrame,
    path: str,
    k: int,
    key: Sequence[str],
    *,
    rows: DataFrame | None = None,
    probes: int = PROBES,
    refine: int = REFINE,
    exclude_self: bool = False,
) -> DataFrame:
    """``(query_id, rank, score, *key)`` of the best rows in the ``probes`` nearest cells of each ``queries(query_id, embedding)``.

    ``rows`` may name fewer rows than all stored ones. ``exclude_self`` drops rows whose first key column equals the
    query's id. Ties go by the key.
    """
    import numpy as np

    spark = queries.sparkSession
    model = load_model(spark, path)
    dim, wide, count = _dimension(spark, path), model.centroids.shape[1], len(model.centroids)
    rows = load_rows(spark, path) if rows is None else rows
    queries = stored(queries.select("query_id", "embedding").where(F.size("embedding") == dim), "asked")

    def padded(vectors):
        return np.pad(vectors, ((0, 0), (0, wide - dim)))

    def probed(batches: Iterator) -> Iterator:
        seen = np.zeros(count, bool)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                seen[model.nearest(padded(_matrix(batch["embedding"].slice(at, 4096))), probes)] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen), pa.int32())], ["cell"])

    cells = [r["cell"] for r in queries.mapInArrow(probed, "cell int").distinct().collect()]  # at most the cells of the model

    def approximate(batch, asked):
        ids, matrix = asked
        matrix = padded(matrix)
        mine = batch["cell"].to_numpy()
        codes = np.frombuffer(b"".join(batch["code"].to_pylist()), "uint8").reshape(batch.num_rows, -1)
        scores = model.products(matrix, mine, codes)
        near = np.zeros((len(matrix), count), bool)
        np.put_along_axis(near, model.nearest(matrix, probes), True, axis=1)
        scores[~near[:, mine]] = -np.inf
        if exclude_self:
            scores[ids[:, None] == batch[key[0]].to_numpy(zero_copy_only=False)[None, :]] = -np.inf
        return scores

    wanted = rows.where(F.col("cell").isin(cells))
    finalists = keyed_topk(queries, wanted, k * refine, key, ["cell"], columns=["cell", "code"], score=approximate)
    finalists = stored(finalists.select("query_id", "cell", *key), "finalists")
    near = [r["cell"] for r in finalists.select("cell").distinct().collect()]
    few = broadcast_bounded(finalists, finalists.count(), 64 + 32 * len(key))
    met = rows.where(F.col("cell").isin(near)).select("cell", *key, F.col("embedding").alias("v")).join(few, ["cell", *key])
    both = met.join(queries, "query_id")
    names = ["query_id", *key]

    def exact(batches: Iterator) -> Iterator:
        for batch in batches:
            score = np.einsum("ij,ij->i", _matrix(batch["embedding"]), _matrix(batch["v"])) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], pa.array(np.round(score, 6))], [*names, "score"])

    kind = T.StructType([*[both.schema[c] for c in names], T.StructField("score", T.DoubleType())])
    scored = both.select(*names, "embedding", "v").mapInArrow(exact, kind)
    best = top_rows(scored, ["query_id"], [F.desc("score"), *[F.asc(c) for c in key]], k)
    return best.select("query_id", "rank", "score", *key)
