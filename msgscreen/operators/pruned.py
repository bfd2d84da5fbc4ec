"""Exact top-k that skips what cannot win.

Both searches know, for each small block of the corpus, a bound of the scores that a query can reach in it, and work
in two rounds: each query's most promising blocks first, which gives the score that its k-th row has at least; then the
blocks whose bound reaches that score. The others are neither read for the query nor sent to it. A block is
read once and meets its queries in one task; nothing is copied for each block of queries.

* BM25: documents in blocks of ``BLOCK_DOCS`` neighbours; for each term of a block the largest count and the least
  length, hence the most that the term can add there, whatever the average length. Terms that cannot carry a row to
  the threshold, all of them together, open no block (max-score); stop words therefore do not pair queries with blocks.
* Dense: vectors in cells with centroid and radius; by Cauchy and Schwarz q.v <= q.c + |q| * radius.

Bounds allow for rounding by ``SLACK``, so rows, scores and ties are those of the plans that score everything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from msgscreen import schema
from msgscreen.operators import ann
from msgscreen.operators.blocks import running_best
from msgscreen.operators.dense import dense_topk, score_fragments
from msgscreen.operators.lexical import (
    K1, B, LexicalIndex, average_length, document_side, idf_of, length_stats, postings_of, query_side, query_terms, query_weights,
    stream_scorer, term_stats_of,
)
from msgscreen.scale import BROADCAST_BYTES, broadcast_bounded, measured, measured_bytes, stored, top_rows

#: Documents of a block: a power of two.
BLOCK_DOCS = 128
#: Documents whose terms are sorted together while the maxima of their blocks are taken.
PEAK_DOCS = 1024
#: Terms of a query, by weight, that choose its blocks of the first round, and how many it chooses.
LEADING_TERMS = 4
FIRST_BLOCKS = 4
#: Scores are ranked by six digits; a bound this close to the threshold still counts.
SLACK = 1e-5

_RUN = "query_id bigint, doc_id bigint, score double"

DOC_BLOCKS = T.StructType([*schema.DOC_TERMS.fields, T.StructField("block", T.LongType()), T.StructField("shelf", T.LongType())])
BLOCK_MAX = T.StructType([
    T.StructField("term", T.StringType()), T.StructField("block", T.LongType()), T.StructField("tf", T.IntegerType()), T.StructField("dl", T.IntegerType()),
])


@dataclass(frozen=True)
class BlockIndex:
    doc_terms: DataFrame  # doc_id, dl, terms, block, shelf (a folder of consecutive blocks)
    block_max: DataFrame  # term, block, largest tf, least dl
    lexical: LexicalIndex  # term and corpus statistics


def _peaks(batches: Iterator) -> Iterator:
    """Largest count and least length of each (block, term) of a batch of documents."""
    import numpy as np
    import pyarrow as pa

    for batch in (whole.slice(at, PEAK_DOCS) for whole in batches for at in range(0, whole.num_rows, PEAK_DOCS)):
        sizes = batch["terms"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = batch["terms"].flatten()
        coded = flat.field("term").dictionary_encode()
        row = np.repeat(np.arange(batch.num_rows), sizes)
        block, dl = batch["block"].to_numpy()[row], batch["dl"].to_numpy()[row]
        code, tf = coded.indices.to_numpy(), flat.field("tf").to_numpy()
        order = np.lexsort((code, block))
        if not len(order):
            continue
        block, dl, code, tf = block[order], dl[order], code[order], tf[order]
        first = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (code[1:] != code[:-1]))))
        columns = [coded.dictionary.take(pa.array(code[first])), pa.array(block[first]), pa.array(np.maximum.reduceat(tf, first)), pa.array(np.minimum.reduceat(dl, first))]
        yield pa.RecordBatch.from_arrays(columns, ["term", "block", "tf", "dl"])


def save_blocks(index: LexicalIndex, path: str, block_docs: int = BLOCK_DOCS) -> None:
    """Store the documents of an index in blocks of neighbours, the largest counts of each block, and the statistics.

    Documents stay in the order and the tasks they are read in, so only the block maxima are shuffled, once, to lie
    together by term.
    """
    spark = index.doc_terms.sparkSession
    # The number of a row: its partition above, its place in the partition in the 33 bits below.
    shelf, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    block = F.shiftleft(shelf, 33) + F.shiftright(place, block_docs.bit_length() - 1)
    numbered = index.doc_terms.select(*schema.DOC_TERMS.fieldNames(), F.monotonically_increasing_id().alias("_at"))
    numbered.withColumns({"block": block, "shelf": shelf}).drop("_at").write.mode("overwrite").partitionBy("shelf").parquet(f"{path}/doc_terms")
    rows = spark.read.schema(DOC_BLOCKS).parquet(f"{path}/doc_terms")
    # By term, not ranged: a range would take the maxima twice, once to find its bounds. A term has a row a block at most.
    peaks = rows.select("block", "dl", "terms").mapInArrow(_peaks, BLOCK_MAX).repartition("term")
    most = peaks.groupBy("term", "block").agg(F.max("tf").alias("tf"), F.min("dl").alias("dl"))  # where a block lies in two batches
    most.sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/block_max")
    lengths = length_stats(rows)
    term_stats, _ = term_stats_of(rows, lengths)
    term_stats.write.mode("overwrite").parquet(f"{path}/term_stats")
    kept = spark.read.schema(schema.TERM_STATS).parquet(f"{path}/term_stats")
    _, mean = idf_of(kept.select("term", "df"), lengths.select("n").scalar())
    lengths.withColumn("avg_idf", mean.scalar()).write.mode("overwrite").parquet(f"{path}/corpus_stats")


def load_blocks(spark: SparkSession, path: str) -> BlockIndex:
    rows = spark.read.schema(DOC_BLOCKS).parquet(f"{path}/doc_terms")
    doc_terms = rows.select(*schema.DOC_TERMS.fieldNames())
    term_stats = spark.read.schema(schema.TERM_STATS).parquet(f"{path}/term_stats")
    corpus_stats = spark.read.schema(schema.CORPUS_STATS).parquet(f"{path}/corpus_stats")
    index = LexicalIndex(doc_terms, postings_of(doc_terms), term_stats, corpus_stats)
    return BlockIndex(rows, spark.read.schema(BLOCK_MAX).parquet(f"{path}/block_max"), index)


def _most(index: BlockIndex, weights: DataFrame, small: bool, k1: float, b: float) -> DataFrame:
    """``(term, block, most)`` for the terms asked: the largest gain a document of the block can have."""
    terms = weights.select("term").distinct()
    rows = index.block_max.join(F.broadcast(terms) if small else terms, "term", "left_semi")
    tf = F.col("tf").cast("double")
    gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / average_length(index.lexical)))
    return rows.select("term", "block", gain.alias("most"))


def _scored_blocks(pairs: DataFrame, sides: DataFrame, index: BlockIndex, k: int, k1: float, b: float) -> DataFrame:
    """Best k of each ``(query_id, block)``; blocks that nobody asks for stay on disk or in their scan."""
    asked = stored(pairs.select("block").distinct().withColumn("shelf", F.shiftright("block", 33)), "asked-blocks")
    shelves = [r["shelf"] for r in asked.select("shelf").distinct().collect()]  # folders: the driver lists them anyway
    wanted = index.doc_terms.where(F.col("shelf").isin(shelves)).join(broadcast_bounded(asked, asked.count(), 32), ["shelf", "block"], "left_semi")
    docs = document_side(wanted, F.col("block").alias("frag")).drop("doc_id")
    queries = sides.join(pairs, "query_id").withColumn("frag", F.col("block")).drop("block", "query_id")
    met = docs.unionByName(queries).repartition("frag").sortWithinPartitions("frag", "side")
    return met.mapInArrow(stream_scorer(k, k1, b), _RUN)


def asked_blocks(
    terms: DataFrame, index: BlockIndex, k: int, small: bool, k1: float = K1, b: float = B, first: int = FIRST_BLOCKS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (query_id, block) of both rounds, and the scored rows of the first."""
    weights = stored(query_weights(terms, index.lexical, small), "weights")
    most = stored(_most(index, weights, small, k1, b), "most")
    sides = stored(query_side(weights, average_length(index.lexical)), "queries")
    cap = F.greatest("w", F.lit(0.0)) * F.col("most")  # a negative weight adds nothing where the term is missing
    leading = top_rows(weights, ["query_id"], [F.desc("w"), F.asc("term")], LEADING_TERMS).drop("rank")
    promised = leading.join(most, "term").groupBy("query_id", "block").agg(F.sum(cap).alias("bound"))
    best = stored(top_rows(promised, ["query_id"], [F.desc("bound"), F.asc("block")], first).select("query_id", "block"), "first-pairs")
    scored = stored(_scored_blocks(best, sides, index, k, k1, b), "first-scores")
    floor = (
        top_rows(scored, ["query_id"], [F.desc("score"), F.asc("doc_id")], k).groupBy("query_id")
        .agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") == k).select("query_id", "floor")
    )
    # Max-score: the terms that cannot reach the floor together open no block.
    peaks = most.groupBy("term").agg(F.max("most").alias("most"))
    ascending = Window.partitionBy("query_id").orderBy("peak", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        weights.join(peaks, "term").select("query_id", "term", "w", cap.alias("peak"))
        .withColumn("total", F.sum("peak").over(ascending)).join(floor, "query_id", "left")
    )
    opens = F.col("floor").isNull() | (F.col("total") >= F.col("floor") - SLACK)
    ranked = stored(ranked.withColumn("opens", opens), "terms")
    rest = ranked.groupBy("query_id").agg(F.coalesce(F.sum(F.when(~F.col("opens"), F.col("peak"))), F.lit(0.0)).alias("rest"), F.max("floor").alias("floor"))
    bounds = ranked.where("opens").select("query_id", "term", "w").join(most, "term").groupBy("query_id", "block").agg(F.sum(cap).alias("bound"))
    open_pairs = bounds.join(rest, "query_id").where(F.col("floor").isNull() | (F.col("bound") + F.col("rest") >= F.col("floor") - SLACK))
    later = open_pairs.select("query_id", "block").join(best, ["query_id", "block"], "left_anti")
    return best, stored(later, "later-pairs"), scored


def bm25_pruned(
    queries: DataFrame, index: BlockIndex, k: int = 20, *, text: str = "text", k1: float = K1, b: float = B, first: int = FIRST_BLOCKS
) -> DataFrame:
    """``(query_id, doc_id, rank, score)``: the rows of ``bm25_topk``, from the blocks that can hold them."""
    terms = query_terms(queries, text)
    _, size = measured(terms)
    small = size <= BROADCAST_BYTES
    _, later, scored = asked_blocks(terms, index, k, small, k1, b, first)
    sides = query_side(query_weights(terms, index.lexical, small), average_length(index.lexical))
    rest = _scored_blocks(later, sides, index, k, k1, b)
    best = top_rows(scored.unionByName(rest), ["query_id"], [F.desc("score"), F.asc("doc_id")], k)
    return best.select("query_id", "doc_id", "rank", "score")


# --- dense ---------------------------------------------------------------------------

#: Rows that place the centroids, drawn by a hash of the id; the layout changes with them, never the result.
FIT_ROWS = 20_000
#: Vectors of a cell on average.
CELL_VECTORS = 256
FIRST_CELLS = 3
#: Above this share of all (query, cell) pairs the plan without bounds is the cheaper one.
WORTHWHILE = 0.5

CELLS = "cell int, n bigint, radius double, centroid array<double>"


@dataclass(frozen=True)
class BoundedCells:
    vectors: DataFrame  # doc_id, embedding, cell
    cells: DataFrame  # cell, n, radius, centroid


def save_cells(corpus: DataFrame, path: str, cells: int | None = None, fit_rows: int = FIT_ROWS, seed: int = 42) -> None:
    """Place every vector ``(doc_id, embedding)`` in its nearest cell, once; a folder a cell, and the cells' radii."""
    spark = corpus.sparkSession
    n = corpus.count()
    if n == 0:
        return store_cells(ann.CellIndex(corpus.select("doc_id", "embedding", F.lit(0).alias("cell")), []), path)
    count = max(2, cells or min(4096, math.ceil(n / CELL_VECTORS)))
    if n <= count:  # each vector is its own centroid
        return store_cells(ann.cells_of(corpus, corpus.select(F.col("doc_id").alias("cell"), "embedding")), path)
    share = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, fit_rows / max(1, n)))
    index = ann.build_cells(corpus.select("doc_id", "embedding"), count, seed, fit_on=corpus.where(share) if n > fit_rows else None)
    store_cells(index, path)


def store_cells(index: ann.CellIndex, path: str) -> None:
    """Store vectors by cell. A cell of more than ``CELL_ROWS`` vectors becomes several, alike but for their ids."""
    import numpy as np

    placed = stored(index.vectors, "placed")
    spark = placed.sparkSession
    sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
    parts = [max(1, -(-sizes.get(c, 0) // ann.CELL_ROWS)) for c in range(len(index.centroids))]
    starts = np.concatenate(([0], np.cumsum(parts)))
    of = lambda values: F.get(F.array(*[F.lit(int(v)) for v in values]), F.col("cell"))
    cell = of(starts[:-1]) + F.pmod(F.xxhash64("doc_id"), of(parts)).cast("int") if parts else F.col("cell")
    split = placed.select("doc_id", "embedding", cell.cast("int").alias("cell"))
    split.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    centroids = np.repeat(np.array(index.centroids), parts, axis=0)

    def distances(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                v = batch["embedding"].flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(batch.num_rows, -1)
                gap = v - centroids[batch["cell"].to_numpy()]
                yield pa.RecordBatch.from_arrays([batch["cell"], pa.array(np.sqrt((gap * gap).sum(axis=1)))], ["cell", "distance"])

    radii = load_vectors(spark, path).select("embedding", "cell").mapInArrow(distances, "cell int, distance double")
    places = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
    sized = radii.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).join(F.broadcast(places), "cell")
    sized.coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")  # at most a few rows a centroid


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.VECTORS.fields, T.StructField("cell", T.IntegerType())])).parquet(f"{path}/vectors")


def load_cells(spark: SparkSession, path: str) -> BoundedCells:
    return BoundedCells(load_vectors(spark, path), spark.read.schema(CELLS).parquet(f"{path}/cells"))


def _bounds(cells: DataFrame):
    """``bounds(matrix)`` -> scores that each query can reach in each cell, and the numbers of the cells; None without cells."""
    import numpy as np

    if measured_bytes(cells) > BROADCAST_BYTES:
        raise ValueError("more cells than may be sent to every task; use fewer, larger ones")
    rows = cells.orderBy("cell").collect()
    if not rows:
        return None
    centroid, radius = np.array([r["centroid"] for r in rows]), np.array([r["radius"] for r in rows])

    def bounds(matrix):
        return matrix @ centroid.T + np.sqrt((matrix * matrix).sum(axis=1))[:, None] * radius[None, :]

    return bounds, np.array([r["cell"] for r in rows], "int32")


def _matrix(column):
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), -1)


def _chosen(bounds, part, first: int, later: bool):
    """Which cells a batch of queries asks for: the ``first`` by bound, or the others that reach the ``floor``."""
    import numpy as np

    bound = bounds(_matrix(part["embedding"]))
    chosen = np.zeros(bound.shape, bool)
    np.put_along_axis(chosen, np.argsort(-bound, axis=1, kind="stable")[:, :first], True, axis=1)
    if not later:
        return chosen
    return ~chosen & (bound >= (part["floor"].to_numpy(zero_copy_only=False) - SLACK)[:, None])


def asked_cells(queries: DataFrame, cells: DataFrame, first: int, later: bool = False) -> DataFrame:
    """``(query_id, embedding, frag)`` of the cells that each query asks for in one of the two rounds."""
    bounds, number = _bounds(cells)

    def choose(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                row, cell = np.nonzero(_chosen(bounds, part, first, later))
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays([part["query_id"].take(taken), part["embedding"].take(taken), pa.array(number[cell])], ["query_id", "embedding", "frag"])

    return queries.mapInArrow(choose, "query_id bigint, embedding array<float>, frag int")


def cell_demand(queries: DataFrame, cells: DataFrame, first: int) -> dict[int, int]:
    """How many queries ask for each cell in the second round: one row a cell comes back, none is sent anywhere."""
    bounds, number = _bounds(cells)

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total = np.zeros(len(number), "int64")
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                total += _chosen(bounds, batch.slice(at, 1024), first, True).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(number[total > 0]), pa.array(total[total > 0])], ["cell", "n"])

    rows = queries.mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    return {r["cell"]: r["n"] for r in rows}


def dense_pruned(
    queries: DataFrame, index: BoundedCells, k: int = 20, *, exclude_self: bool = False, first: int = FIRST_CELLS,
    worthwhile: float = WORTHWHILE, plan: str = "auto",
) -> DataFrame:
    """``(query_id, doc_id, rank, score)``: the rows of ``dense_topk``.

    The second round scans the asked cells past the queries, which then go to every task and multiply only those that
    ask for the cell at hand; a query side beyond the broadcast bound goes to its cells instead (``plan='pairs'``), unless
    the bounds keep more than ``worthwhile`` of all pairs, when ``dense_topk`` is the cheaper way.
    """
    queries = queries.select("query_id", "embedding")
    if _bounds(index.cells) is None:
        return dense_topk(queries, index.vectors, k, exclude_self=exclude_self)
    nearest = stored(_scored_cells(asked_cells(queries, index.cells, first), index, k, exclude_self), "first-scores")
    floor = (
        top_rows(nearest, ["query_id"], [F.desc("score"), F.asc("doc_id")], k).groupBy("query_id")
        .agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
    )
    asked = queries.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    asked = stored(asked, "floors")
    demand = cell_demand(asked, index.cells, first)
    small = plan == "scan" or plan == "auto" and measured_bytes(queries) <= BROADCAST_BYTES
    if small:
        rest = _scan_cells(asked, index, k, exclude_self, first, sorted(demand))
    elif sum(demand.values()) > worthwhile * queries.count() * index.cells.count():
        return dense_topk(queries, index.vectors, k, exclude_self=exclude_self)
    else:
        rest = _scored_cells(asked_cells(asked, index.cells, first, True), index, k, exclude_self)
    ranked = top_rows(nearest.unionByName(rest), ["query_id"], [F.desc("score"), F.asc("doc_id")], k)
    return ranked.select("query_id", "doc_id", "rank", "score")


def _scan_cells(asked: DataFrame, index: BoundedCells, k: int, exclude_self: bool, first: int, wanted: list[int]) -> DataFrame:
    """Second round without a shuffle: each task holds the queries, their floors and their best rows so far."""
    table = asked.toArrow().combine_chunks()  # bounded: the caller measured it
    shared = asked.sparkSession.sparkContext.broadcast(table)
    bounds, number = _bounds(index.cells)
    collect = running_best(k)

    def scan(batches: Iterator) -> Iterator:
        import numpy as np

        held = shared.value
        if not held.num_rows:
            return
        ids = held["query_id"].to_numpy()
        matrix = _matrix(held["embedding"].combine_chunks())
        chosen = np.zeros((len(ids), int(number.max()) + 1), bool)
        for at in range(0, len(ids), 1024):
            part = held.slice(at, 1024).combine_chunks().to_batches()[0]
            chosen[at : at + 1024, number] = _chosen(bounds, part, first, True)
        add, results = collect(ids, held["floor"].to_numpy())
        for batch in batches:
            cell = batch["cell"].to_numpy()
            edges = np.flatnonzero(np.diff(cell) != 0) + 1
            for lo, hi in zip([0, *edges], [*edges, len(cell)]):
                if lo == hi:
                    continue
                docs, vectors = batch["doc_id"].slice(lo, hi - lo).to_numpy(), _matrix(batch["embedding"].slice(lo, hi - lo))
                asks = np.flatnonzero(chosen[:, cell[lo]])
                step = max(1, (1 << 22) // len(docs))
                for at in range(0, len(asks), step):
                    some = asks[at : at + step]
                    scores = matrix[some] @ vectors.T
                    if exclude_self:
                        scores[ids[some, None] == docs[None, :]] = -np.inf
                    add(some, docs, scores)
        yield from results()

    return index.vectors.where(F.col("cell").isin(wanted)).select("doc_id", "embedding", "cell").mapInArrow(scan, _RUN)


def _scored_cells(pairs: DataFrame, index: BoundedCells, k: int, exclude_self: bool) -> DataFrame:
    """Best k of each (query, cell); only folders of cells that some query asks for are read."""
    pairs = stored(pairs, "cell-pairs")
    cells = [r["frag"] for r in pairs.select("frag").distinct().collect()]  # folders, at most a few for each of the measured centroids
    wanted = index.vectors.where(F.col("cell").isin(cells))
    last = index.cells.agg(F.max("cell")).first()[0]
    return score_fragments(pairs, wanted.withColumnRenamed("cell", "frag"), k, 1 + (last or 0), exclude_self)
