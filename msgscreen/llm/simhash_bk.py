"""Near-duplicates by SimHash fingerprints and BK-trees.

1. A text's fingerprint has a bit for each of 64 places: 1 where more than half of the XXH64 values (seed 42) of its
   ``WORDS``-word shingles, repeats included, have it set. Fewer words make one shingle, no words the fingerprint 0.
   Documents of equal fingerprints form a class; only classes are compared.
2. Two fingerprints that differ in at most r bits agree in one of r + 1 blocks of bits. Classes are filed under the
   low bits of each block; the number of bits follows the number of classes, so that a shard holds about ``SHARD``.
   The filing never parts a pair: more bits mean smaller shards, not other results.
3. Each shard's fingerprints make a BK-tree: the children of a node are keyed by their integer Hamming distance to it.
   A query follows only edges whose key is within r of its own distance to the node; the tree is searched level by
   level for all queries of the shard at once. Crowded shards are split into pieces of about ``PIECE``; the tree of a
   piece is sent to the queries of each other piece of its shard.
4. A task turns its hits into at most one link a fingerprint (to the least of those connected in that task); links
   meet in label rounds on Spark tables, so neither pairs nor components of all documents ever stand in one place.

Null texts count as empty; all texts without words have fingerprint 0 and link like any other. Rows without an id get
a fingerprint, link with nothing and have no component. Rows that repeat an id are judged row by row. An empty table
gives an empty result. Very long texts are hashed in pieces. Extra columns take no part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgscreen.llm.bottomk import components
from msgscreen.llm.common import LOWER, encoded, pieces, scratch

WORDS = 3
RADIUS = 2
SEED = 42
SHARD = 256
PIECE = 512
#: (query, node) pairs in flight while a tree is searched.
FRONTIER = 1 << 18


def fingerprint(text: bytes, size: int = WORDS) -> int:
    ones, n, held = np.zeros(64, np.int64), 0, []
    for piece in pieces(text):
        words = held + piece.translate(LOWER).split()
        held = words[max(0, len(words) - size + 1) :]
        if len(words) < size:
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: len(words) - size])).tolist()
        joined = b" ".join(words)
        ones += _ones([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())])
        n += len(starts)
    if n == 0 and held:  # fewer words than a shingle
        ones, n = _ones([xxhash.xxh64_intdigest(b" ".join(held), SEED)]), 1
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _ones(hashes: list[int]) -> np.ndarray:
    """How many hashes have each bit set."""
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


class BKTree:
    """Tree over an array of 64-bit values; node i is value i, node 0 the root."""

    def __init__(self, values: np.ndarray):
        self.values = values
        m = len(values)
        parent, key = np.zeros(m, np.int64), np.zeros(m, np.int64)
        moving, at = np.arange(1, m), np.zeros(max(0, m - 1), np.int64)
        while len(moving):  # all values move down one level: the first to take an edge becomes its child
            distance = np.bitwise_count(values[moving] ^ values[at]).astype(np.int64)
            order = np.lexsort((moving, distance, at))
            moving, at, distance = moving[order], at[order], distance[order]
            new = np.concatenate(([True], (at[1:] != at[:-1]) | (distance[1:] != distance[:-1])))
            parent[moving[new]], key[moving[new]] = at[new], distance[new]
            child = moving[new][np.cumsum(new) - 1]
            moving, at = moving[~new], child[~new]
        edges = parent[1:] * 65 + key[1:]
        order = np.argsort(edges, kind="stable")
        self.edges, self.children = edges[order], order + 1

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query number, node) of all pairs within ``radius``."""
        step = max(1, FRONTIER // max(1, len(self.values)))
        found = [self._within(queries[a : a + step], radius, a) for a in range(0, len(queries), step)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _within(self, queries: np.ndarray, radius: int, first: int) -> tuple[np.ndarray, np.ndarray]:
        query, node, hits = np.arange(len(queries)), np.zeros(len(queries), np.int64), []
        while len(query):
            distance = np.bitwise_count(queries[query] ^ self.values[node]).astype(np.int64)
            hit = distance <= radius
            hits.append((query[hit] + first, node[hit]))
            low = np.searchsorted(self.edges, node * 65 + np.maximum(distance - radius, 0))
            high = np.searchsorted(self.edges, node * 65 + np.minimum(distance + radius, 64), side="right")
            many = high - low
            query = np.repeat(query, many)
            node = self.children[np.repeat(high - np.cumsum(many), many) + np.arange(many.sum())]
        return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


def least_connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n points the smallest point connected with it by the edges (a, b)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(label, before):
            return label


def _judge(radius: int):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        values = rows.column("fp").to_numpy().view(np.uint64)
        role = rows.column("role").to_numpy()
        order = np.lexsort((values, role))  # trees first; the order of arrival does not matter
        values, role = values[order], role[order]
        trees = values[role <= 0]
        links = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        if len(trees) and role[-1] >= 0:
            asked = np.flatnonzero(role >= 0)
            query, node = BKTree(trees).within(values[asked], radius)
            least = least_connected(len(values), asked[query], node)
            linked = np.flatnonzero(least != np.arange(len(values)))
            found = [values[linked].view(np.int64), values[least[linked]].view(np.int64)]
        else:
            found = [np.zeros(0, np.int64)] * 2
        yield pa.RecordBatch.from_arrays([pa.array(f) for f in found], schema=links)

    return judge


def links_within(classes: DataFrame, radius: int = RADIUS, shard: int = SHARD, piece: int = PIECE) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints ``fp`` joined by chains of steps within ``radius`` bits."""
    n = classes.count()
    bits = max(0, math.ceil(math.log2(max(1, n) / shard)))
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    filed = []
    for k in range(radius + 1):
        width = min(bits, edges[k + 1] - edges[k], 48)
        low = F.shiftrightunsigned("fp", edges[k]).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
        filed.append(F.lit(k).cast("bigint") * F.lit(1 << 48) + low)
    placed = classes.select("fp", F.explode(F.array(*filed)).alias("shard"))
    load = placed.groupBy("shard").agg(F.count("*").alias("m")).where("m > 1")
    split = placed.join(load.select("shard", F.ceil(F.col("m") / piece).cast("int").alias("split")), "shard")
    own = F.pmod(F.xxhash64("fp"), "split").cast("int")
    met = split.select("fp", "shard", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("split") - 1)).alias("other"))
    met = met.select(
        "fp", "shard", F.least("own", "other").alias("tree"), F.greatest("own", "other").alias("asks"),
        F.signum(F.col("own") - F.col("other")).cast("int").alias("role"),  # -1 tree, 1 query, 0 both
    )
    return met.groupBy("shard", "tree", "asks").applyInArrow(_judge(radius), "a bigint, b bigint")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS) -> DataFrame:
    """(id, fp): a row for each row of ``docs``."""

    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.array([fingerprint(t, size) for t in encoded(batch)], np.uint64).view(np.int64))

    return docs.select(F.col(doc_id).cast("bigint").alias("id"), F.arrow_udf(hashed, "bigint")(F.col(text)).alias("fp"))


def linked(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS, radius: int = RADIUS, shard: int = SHARD, piece: int = PIECE
) -> DataFrame:
    """One row a document: doc_id, fingerprint (hex), component_id (smallest id reachable, itself included)."""
    spark = docs.sparkSession
    path = scratch(spark, "fingerprints")
    fingerprints(docs, doc_id, text, size).write.parquet(path)
    rows = spark.read.parquet(path)
    classes = rows.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep"))
    label = components(links_within(classes.select("fp"), radius, shard, piece))
    named = classes.join(label.select(F.col("id").alias("fp"), "comp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    found = rows.join(named.join(least, "comp").select("fp", "component_id"), "fp", "left")
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
