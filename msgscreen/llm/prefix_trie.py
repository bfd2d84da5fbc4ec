"""Trie of shared conversation prefixes by range minima over sorted common prefixes.

1. Turns are numbered inside their conversation by one range sort, whatever a conversation's size (``numbered``).
2. A turn becomes a 128-bit hash of (depth, role, text); a prefix is known by the exclusive or of its turns' hashes.
   Sequences are cut into segments of ``SPAN`` turns; a segment carries the hash of the prefix before it, so one row
   stays bounded. Segments are range-sorted by (prefix before, turns, conversation): equal sequences and hot first
   turns spread over as many tasks as they need.
3. In a block of sorted rows a sparse table holds range minima of the common prefixes of neighbours. Every candidate
   prefix (row, depth) binary-searches how far left and how far right the minima stay at its depth or above, each on
   its own. The leftmost row of an interval gives the node; the interval gives its members, a second sparse table the
   smallest of them, and sums over the nodes in order of (row, depth) give the subtree.
4. Nodes whose interval touches neither end of the block are final. The others (at most two paths a block) are
   merged by their hash; each such node also adds to its ancestors. Lists of members that end at a node travel as
   sorted fragments and are hashed in order.
5. Segments beyond the first are done from the deepest up: the sums of their topmost nodes are carried to the node
   that their prefix ends at. There are as many rounds as segments in the longest sequence.

Rows without a conversation id belong to no conversation. Null roles and texts count as empty. Turns of one number
go by role, the first 64 characters of the text, then its digest; a null number comes first; repeated rows are turns
of their own. An empty table gives no node. Very long texts only pass through their digest. Extra columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from msgscreen.llm.common import scratch

SPAN = 512
#: A block of sorted rows ends at so many rows or turns.
BLOCK_ROWS = 1 << 16
BLOCK_TURNS = 1 << 19
NOTHING = hashlib.sha256(b"").hexdigest()

LOCAL = (
    "x bigint, y bigint, px bigint, py bigint, depth bigint, conv bigint, parent bigint, n bigint, children bigint, leaves bigint, "
    "saved bigint, size bigint, ends string, edge boolean, first_end bigint, ids binary, carried_leaves bigint, "
    "carried_saved bigint, carried_children bigint, path array<struct<vx:bigint,vy:bigint>>"
)


def numbered(table: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, part, place, digest, size) in order of ``place``, and where each conversation starts in each part.

    The second frame has (conv_id, part, first, before): a turn's number in its conversation is place - first + before.
    """
    said, who = F.coalesce(text, F.lit("")), F.coalesce(role, F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, said).cast("binary")))
    keyed = table.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"), who.alias("role"), F.left(said, F.lit(64)).alias("head"),
        digest.alias("digest"), F.length(said).cast("bigint").alias("size"),
    )
    order = ["conv_id", "turn", "role", "head", "digest"]
    path = scratch(table.sparkSession, "turns")
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.select("conv_id", F.monotonically_increasing_id().alias("place"), "digest", "size").write.parquet(path)
    turns = table.sparkSession.read.parquet(path).withColumn("part", F.shiftright("place", 33))
    parts = turns.groupBy("conv_id", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return turns, parts.select("conv_id", "part", "first", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


class Minima:
    """Sparse table: minima of all ranges whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        out = np.empty(len(first), self.rows[0].dtype)
        level = np.int64(np.log2(last - first + 1)) if len(first) else np.zeros(0, np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.rows[k][first[at]], self.rows[k][last[at] - (1 << k) + 1])
        return out

    def left_extent(self, row: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Smallest l such that all values at l + 1 .. row are ``bound`` or more."""
        at = row.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            to = at - (1 << k)
            at = np.where((to >= 0) & (self.rows[k][np.clip(to + 1, 0, len(self.rows[k]) - 1)] >= bound), to, at)
        return at

    def right_extent(self, row: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Largest r such that all values at row + 1 .. r are ``bound`` or more."""
        at, n = row.copy(), len(self.rows[0])
        for k in range(len(self.rows) - 1, -1, -1):
            to = at + (1 << k)
            at = np.where((to < n) & (self.rows[k][np.clip(at + 1, 0, len(self.rows[k]) - 1)] >= bound), to, at)
        return at


def common_prefixes(offset: np.ndarray, x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
    """Turns that each row shares with the row before it; -1 where they start from different prefixes."""
    n = len(offset) - 1
    length = np.diff(offset)
    out = np.full(n, -1, np.int64)
    live = np.flatnonzero((cx[1:] == cx[:-1]) & (cy[1:] == cy[:-1])) + 1
    depth = 0
    while len(live):
        out[live] = depth
        live = live[(length[live] > depth) & (length[live - 1] > depth)]
        a, b = offset[live] + depth, offset[live - 1] + depth
        live = live[(x[a] == x[b]) & (y[a] == y[b])]
        depth += 1
    return out


def _nodes(rows: pa.Table, base: int) -> pa.RecordBatch:
    """Nodes of a block of sorted rows whose sequences start at depth ``base``."""
    column = lambda name: rows.column(name).combine_chunks()
    conv, cx, cy = (column(c).to_numpy(zero_copy_only=False) for c in ("conv_id", "cx", "cy"))
    more = column("more").to_numpy(zero_copy_only=False)
    carried = [column(c).to_numpy(zero_copy_only=False) for c in ("carried_leaves", "carried_saved", "carried_children")]
    listed = column("s")
    offset = listed.offsets.to_numpy().astype(np.int64)
    inner = listed.values
    x, y, size = (inner.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "size"))
    n, length = len(conv), np.diff(offset)
    lcp = common_prefixes(offset, x, y, cx, cy)
    minima = Minima(lcp)

    # All candidates (row, depth); depth 0 is the root, which only the first segments have.
    low = 0 if base == 0 else 1
    many = length + 1 - low
    start = np.concatenate(([0], np.cumsum(many)))
    row = np.repeat(np.arange(n), many)
    depth = np.arange(start[-1]) - np.repeat(start[:-1], many) + low
    left = minima.left_extent(row, depth)
    own = left == row
    node_row, node_depth = row[own], depth[own]
    right = minima.right_extent(node_row, node_depth)
    count = len(node_row)
    first_node = np.concatenate(([0], np.cumsum(np.bincount(node_row, minlength=n))))  # nodes of the rows before
    number = np.full(start[-1], -1, np.int64)  # of a candidate that is a node
    number[own] = np.arange(count)
    place = start[node_row] + node_depth - low
    up = node_depth > low
    parent = np.full(count, -1, np.int64)
    above = place[up] - 1  # the candidate one turn shorter; its node belongs to the leftmost row of its interval
    parent[up] = number[start[left[above]] + node_depth[up] - 1 - low]

    members = right - node_row + 1
    least = Minima(conv).least(node_row, right)
    children = np.bincount(parent[up], minlength=count)
    chain_x, chain_y = (np.concatenate(([0], np.bitwise_xor.accumulate(v))) if len(v) else np.zeros(1, np.int64) for v in (x, y))
    key = lambda chain, c, d: chain[offset[node_row] + d] ^ chain[offset[node_row]] ^ c[node_row]
    kx, ky = key(chain_x, cx, node_depth), key(chain_y, cy, node_depth)
    before = np.maximum(node_depth - 1, 0)
    px, py = key(chain_x, cx, before), key(chain_y, cy, before)
    last = np.where(node_depth > 0, size[np.minimum(offset[node_row] + before, max(len(size) - 1, 0))] if len(size) else 0, 0)
    full = length[node_row] == node_depth
    with_carry = [np.where(full, c[node_row], 0) for c in carried]

    edge = (node_row == 0) | (right == n - 1)
    leaf = (children == 0) & (with_carry[2] == 0)
    sums = []
    for value in (leaf + with_carry[0], (members - 1) * last + with_carry[1]):
        total = np.concatenate(([0], np.cumsum(np.where(edge, 0, value))))
        sums.append(total[first_node[right + 1]] - total[np.arange(count)])
    inner_children = np.bincount(parent[up & ~edge], minlength=count)

    ends: list[str | None] = [NOTHING] * count
    first_end: list[int | None] = [None] * count
    ids: list[bytes | None] = [None] * count
    same = np.concatenate((lcp[1:] < np.maximum(length[1:], length[:-1]), [True]))  # the last of equal rows
    stop = np.flatnonzero(same)
    stop = stop[np.searchsorted(stop, np.arange(n))] + 1
    for k in np.flatnonzero(full).tolist():
        i = node_row[k]
        ending = conv[i : stop[i]][~more[i : stop[i]]]
        if len(ending):
            text = ",".join(map(str, ending.tolist())).encode()
            ends[k] = hashlib.sha256(text).hexdigest()
            if edge[k]:
                first_end[k], ids[k] = int(ending[0]), text
    path: list = [None] * count
    for k in np.flatnonzero(edge).tolist():  # parents come first
        path[k] = [*(path[parent[k]] if parent[k] >= 0 else []), {"vx": int(kx[k]), "vy": int(ky[k])}]
    open_parent = (parent < 0) | edge[np.maximum(parent, 0)]
    known = pa.array(np.where(open_parent, 0, least[np.maximum(parent, 0)]), pa.int64(), mask=open_parent)
    columns = [
        kx, ky, px, py, base + node_depth, least, known, members, np.where(edge, inner_children, children + with_carry[2]), sums[0], sums[1],
        last, pa.array(ends, pa.string()), edge, pa.array(first_end, pa.int64()), pa.array(ids, pa.binary()), *with_carry,
        pa.array(path, pa.list_(pa.struct([("vx", pa.int64()), ("vy", pa.int64())]))),
    ]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c if c.dtype == bool else c.astype(np.int64)) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in LOCAL.split(", ")])


def _blocks(base: int, rows_bound: int, turns_bound: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, turns = [], 0, 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                offset = batch.column("s").offsets.to_numpy()[at:]
                take = min(rows_bound - rows, int(np.searchsorted(offset - offset[0], turns_bound - turns, side="right")) - 1)
                take = max(0 if held else 1, min(take, batch.num_rows - at))
                if take:
                    held.append(batch.slice(at, take))
                    rows, turns, at = rows + take, turns + int(offset[take] - offset[0]), at + take
                if rows >= rows_bound or at < batch.num_rows:
                    yield _nodes(pa.Table.from_batches(held), base)
                    held, rows, turns = [], 0, 0
        if held:
            yield _nodes(pa.Table.from_batches(held), base)

    return find


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the fragments of each (x, y), which come in order; memory of one fragment."""
    key, state, out = None, None, []
    names = ["x", "y", "hash"]
    kinds = [pa.int64(), pa.int64(), pa.string()]
    make = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(3)], names)
    for batch in batches:
        for x, y, text in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "ids"))):
            if (x, y) != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (x, y), hashlib.sha256(text)
            else:
                state.update(b"," + text)
        if out:
            yield make()
            out.clear()
    if key is not None:
        out.append((*key, state.hexdigest()))
        yield make()


def _level(rows: DataFrame, base: int, rows_bound: int, turns_bound: int) -> DataFrame:
    """All nodes of one segment level: final sums, ``parent`` null where the parent is not known yet."""
    spark = rows.sparkSession
    order = ["cx", "cy", "key", "conv_id"]
    keyed = rows.withColumn("key", F.transform("s", lambda v: F.struct(v["x"], v["y"])))
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("key")
    path = scratch(spark, "trie-nodes")
    ranged.mapInArrow(_blocks(base, rows_bound, turns_bound), LOCAL).write.parquet(path)
    local = spark.read.schema(LOCAL).parquet(path)
    result = ["x", "y", "px", "py", "depth", "conv", "parent", "n", "children", "leaves", "saved", "ends", "edge"]
    inner = local.where("NOT edge").select(*result)

    edges = local.where("edge")
    largest = lambda *names: [F.max(c).alias(c) for c in names]
    merged = edges.groupBy("x", "y").agg(
        *largest("px", "py", "depth", "size", "carried_leaves", "carried_saved", "carried_children"), F.min("conv").alias("conv"),
        *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")],
    )
    between = merged.where(F.col("depth") > base).groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("edge_children"))
    merged = merged.join(between, ["x", "y"], "left").withColumn("children", F.expr("children + coalesce(edge_children, 0) + carried_children"))
    own = merged.select(
        F.col("x").alias("ux"), F.col("y").alias("uy"), (F.expr("int(children = 0)") + F.col("carried_leaves")).alias("own_leaves"),
        ((F.col("n") - 1) * F.col("size") + F.col("carried_saved")).alias("own_saved"),
    )
    pairs = edges.select(F.col("x").alias("ux"), F.col("y").alias("uy"), F.inline("path")).distinct()
    added = pairs.join(own, ["ux", "uy"]).groupBy(F.col("vx").alias("x"), F.col("vy").alias("y")).agg(
        F.sum("own_leaves").alias("own_leaves"), F.sum("own_saved").alias("own_saved")
    )
    fragments = edges.where("ids IS NOT NULL").select("x", "y", "first_end", "ids")
    hashes = fragments.repartition("x", "y").sortWithinPartitions("x", "y", "first_end").mapInArrow(_hashed, "x bigint, y bigint, hash string")
    outer = merged.join(added, ["x", "y"]).join(hashes, ["x", "y"], "left").select(
        "x", "y", "px", "py", "depth", "conv", F.lit(None).cast("bigint").alias("parent"), "n", "children",
        (F.col("leaves") + F.col("own_leaves")).alias("leaves"), (F.col("saved") + F.col("own_saved")).alias("saved"),
        F.coalesce("hash", F.lit(NOTHING)).alias("ends"), F.lit(True).alias("edge"),
    )
    path = scratch(spark, "trie-level")
    inner.unionAll(outer).write.parquet(path)
    return spark.read.parquet(path)


def trie(
    turns: DataFrame, ids: DataFrame, span: int = SPAN, rows_bound: int = BLOCK_ROWS, turns_bound: int = BLOCK_TURNS
) -> DataFrame:
    """Nodes of the trie of sequences ``turns`` (conv_id, depth from 1, digest, size); ``ids`` has each conv_id once.

    A row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved (sum over the
    subtree of (members - 1) * size of the last turn), ends_sha256 (of the ids of the members that end there).
    """
    spark = turns.sparkSession
    hashed = turns.select(
        "conv_id", F.floor((F.col("depth") - 1) / span).alias("segment"),
        F.struct("depth", *[F.xxhash64(F.lit(k), "depth", "digest").alias(c) for k, c in ((1, "x"), (2, "y"))], "size").alias("t"),
    )
    joined = lambda field: F.aggregate("s", F.lit(0).cast("bigint"), lambda a, v: a.bitwiseXOR(v[field]))
    segments = hashed.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list("t")).alias("s"))
    path = scratch(spark, "trie-segments")
    segments.select("conv_id", "segment", "s", joined("x").alias("sx"), joined("y").alias("sy")).write.parquet(path)
    segments = spark.read.parquet(path)
    levels = int(segments.agg(F.max("segment")).first()[0] or 0) + 1
    of = Window.partitionBy("conv_id").orderBy("segment")
    earlier = of.rowsBetween(Window.unboundedPreceding, -1)
    if levels > 1:  # one row for ``span`` turns; sequences of a single segment need no such sort
        long = segments.where("segment > 0").select("conv_id").distinct()
        heads = segments.join(long, "conv_id", "left_semi").select(
            "conv_id", "segment", *[F.coalesce(F.bit_xor(f"s{c}").over(earlier), F.lit(0)).alias(f"c{c}") for c in "xy"],
            F.lead("segment").over(of).isNotNull().alias("more"),
        )
        segments = segments.join(heads, ["conv_id", "segment"], "left")
        segments = segments.fillna(0, ["cx", "cy"]).fillna(False, ["more"])
    else:
        segments = segments.withColumns({"cx": F.lit(0).cast("bigint"), "cy": F.lit(0).cast("bigint"), "more": F.lit(False)})
    found, carry = [], None
    for level in range(levels - 1, -1, -1):
        rows = segments.where(F.col("segment") == level)
        if level == 0:
            rows = ids.select("conv_id").join(rows, "conv_id", "left").fillna(0, ["sx", "sy", "cx", "cy"]).fillna(False, ["more"])
            rows = rows.withColumn("s", F.coalesce("s", F.array().cast(segments.schema["s"].dataType)))
        rows = rows.select("conv_id", "s", "cx", "cy", "more", F.col("cx").bitwiseXOR(F.col("sx")).alias("x"), F.col("cy").bitwiseXOR(F.col("sy")).alias("y"))
        extra = ["carried_leaves", "carried_saved", "carried_children"]
        if carry is None:
            rows = rows.withColumns({c: F.lit(0).cast("bigint") for c in extra})
        else:
            rows = rows.join(carry, ["x", "y"], "left").fillna(0, extra)
        nodes = _level(rows.drop("x", "y"), level * span, rows_bound, turns_bound)
        found.append(nodes)
        top = nodes.where(F.col("depth") == level * span + 1).groupBy(F.col("px").alias("x"), F.col("py").alias("y"))
        carry = top.agg(F.sum("leaves").alias(extra[0]), F.sum("saved").alias(extra[1]), F.count("*").alias(extra[2]))
    nodes = found[0]
    for other in found[1:]:
        nodes = nodes.unionAll(other)
    # Parents that were open: on the paths of block ends, or in the segment before.
    anchors = nodes.where(F.col("edge") | (F.col("depth") % span == 0)).select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv").alias("above"))
    open_ones = nodes.where("parent IS NULL AND depth > 0").join(anchors, ["px", "py"], "left")
    done = nodes.where("parent IS NOT NULL OR depth = 0").withColumn("above", F.col("parent"))
    columns = ["conv", "depth", "above", "n", "children", "leaves", "saved", "ends"]
    named = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256"]
    return done.select(*columns).unionAll(open_ones.select(*columns)).toDF(*named)
