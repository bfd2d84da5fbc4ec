"""Top-k whose winners keep their identity: any key columns, the score, and what else the caller wants of them.

The table is scanned once. Queries, measured first, go to every task (in batches of whole queries beyond the broadcast
bound); a task holds the best k rows a query, key and kept columns included, so nothing is looked up or scored a second
time. Scores are rounded to 6 digits; ties go by the key columns, in their order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from msgscreen.operators.blocks import best_k
from msgscreen.scale import BROADCAST_BYTES, FAN_IN, measured_bytes, top_rows

#: Scores of a block in flight.
BLOCK_SCORES = 1 << 22


def inner_products(batch, queries):
    """Scores (queries x rows) of a batch by its ``embedding`` column; ``queries`` is (ids, matrix)."""
    vectors = batch["embedding"].flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(batch.num_rows, -1)
    return queries[1] @ vectors.T


def _running_rows(k: int, key: Sequence[str], names: Sequence[str]):
    """Per-task state: the first k rows of every query, as rows of a small table."""
    best = best_k(k)

    def collect(query_ids):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        n = len(query_ids)
        scores, slots = np.full((n, k), -np.inf), np.full((n, k), -1, "int64")
        pool: list = [None]

        def ranks(table):
            """Place of each row in the order of the key."""
            order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in key], null_placement="at_start").to_numpy()
            place = np.empty(len(order), "int64")
            place[order] = np.arange(len(order))
            return place, order

        def add(table, score) -> None:
            """``score(first, last)`` gives the scores of those queries for the rows of ``table``."""
            place, order = ranks(table)
            step = max(1, BLOCK_SCORES // max(1, table.num_rows))
            line, row, value = [], [], []
            for at in range(0, n, step):
                rows, places, top = best(place, score(at, min(n, at + step)), scores[at : at + step, -1])
                line.append(rows + at)
                row.append(order[places])
                value.append(top)
            line, row, value = np.concatenate(line), np.concatenate(row), np.concatenate(value)
            if not len(line):
                return
            used, row = np.unique(row, return_inverse=True)
            fresh = table.take(pa.array(used))
            held = pool[0].num_rows if pool[0] is not None else 0
            merged = pa.concat_tables([pool[0], fresh]) if held else fresh
            place, _ = ranks(merged)
            place = np.append(place, len(place))  # slot -1: no row
            touched = np.unique(line)
            wide_slots = np.full((len(touched), 2 * k), -1, "int64")
            wide = np.full((len(touched), 2 * k), -np.inf)
            wide_slots[:, :k], wide[:, :k] = slots[touched], scores[touched]
            at = k + np.arange(len(line)) - np.searchsorted(line, line, side="left")
            wide_slots[np.searchsorted(touched, line), at], wide[np.searchsorted(touched, line), at] = row + held, value
            order = np.lexsort((place[wide_slots], -wide), axis=1)[:, :k]
            slots[touched], scores[touched] = np.take_along_axis(wide_slots, order, axis=1), np.take_along_axis(wide, order, axis=1)
            kept, slots[slots >= 0] = np.unique(slots[slots >= 0], return_inverse=True)
            pool[0] = merged.take(pa.array(kept))

        def results():
            line, col = np.nonzero(slots >= 0)
            for at in range(0, len(line), 1 << 14):
                a, b = line[at : at + (1 << 14)], col[at : at + (1 << 14)]
                rows = pool[0].take(pa.array(slots[a, b])).combine_chunks()
                columns = [rows.column(c).combine_chunks() for c in names]
                columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[a]), pa.array(scores[a, b]), *columns], ["query_id", "score", *names])

        return add, results

    return collect


def keyed_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    key: Sequence[str],
    keep: Sequence[str] = (),
    *,
    columns: Sequence[str] = ("embedding",),
    score: Callable = inner_products,
    query_bytes: int | None = None,
) -> DataFrame:
    """``(query_id, rank, score, *key, *keep)``: the k best rows of ``corpus`` for each of ``queries(query_id, embedding)``.

    ``score(batch, (ids, matrix))`` scores the ``columns`` of an Arrow batch; minus infinity never wins.
    ``query_bytes`` is a proven bound of the query side; without it the side is measured.
    """
    queries = queries.select("query_id", "embedding")
    size = measured_bytes(queries) if query_bytes is None else query_bytes
    parts = max(1, math.ceil(size / BROADCAST_BYTES))
    names = [*key, *[c for c in keep if c not in key]]
    read = corpus.select(*names, *[c for c in columns if c not in names])
    out = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("score", T.DoubleType()), *[read.schema[c] for c in names]])
    collect = _running_rows(k, key, names)

    def scan(table) -> DataFrame:
        import numpy as np

        n = table.num_rows
        flat = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        shared = corpus.sparkSession.sparkContext.broadcast((table["query_id"].to_numpy(), np.asarray(flat, "float64").reshape(n, -1) if n else np.zeros((0, 0))))

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            ids, matrix = shared.value
            add, results = collect(ids)
            for batch in batches:
                for at in range(0, batch.num_rows if len(ids) else 0, 8192):
                    block = batch.slice(at, 8192)
                    add(pa.Table.from_batches([block.select(names)]), lambda a, b, block=block: score(block, (ids[a:b], matrix[a:b])))
            yield from results()

        return read.mapInArrow(run, out)

    share = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    sides = [queries.where(share == i) for i in range(parts)] if parts > 1 else [queries]
    found = reduce(DataFrame.unionByName, [scan(side.toArrow()) for side in sides])  # each side is within the bound
    order = [F.desc("score"), *[F.asc(c) for c in key]]
    grouped = found.withColumn("_g", F.floor(F.spark_partition_id() / FAN_IN))  # rows of many tasks meet in groups first
    first = top_rows(grouped, ["query_id", "_g"], order, k).drop("rank", "_g")
    return top_rows(first, ["query_id"], order, k).select("query_id", "rank", "score", *names)
