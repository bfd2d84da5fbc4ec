"""Removal of repeated substrings by suffix arrays built with induced sorting.

A byte goes if a ``WIDTH``-byte string covers it that also starts in a document with a smaller id. The corpus
is cut into chunks of documents, and the strings into shards, so that no task needs more than a chunk or shard:

1. Every ``WIDTH``-byte string has a minimizer, its ``GRAM``-byte substring of lowest hash. Chunks send their
   distinct minimizers to shards; a minimizer seen in two documents is sent back. Strings of others are unique.
2. Chunks cut what is left into segments, maximal runs of strings with one minimizer, and send each distinct
   segment once, with the smallest id that has it, to the shard of its minimizer: equal strings meet there.
3. A shard sorts the suffixes of its distinct segments: suffixes are classified, leftmost-smaller substrings
   sorted by induction and named, the names sorted recursively, the array induced from them in linear passes.
   Permuted common prefixes (in text order, from the irreducible ones) give the groups of equal strings
   and each group's smallest id. What has a smaller id than the chunk's own goes back as a bit mask.
4. Chunks cut the masked strings, and the repeats of their own segments, out of their documents.

Identical texts are settled first by their digest; only the smallest id of each takes part above. A line
that very many documents carry is one entry per chunk. Texts move by one shuffle, which all steps share.

Null texts count as empty. Rows that repeat an id are one document: none removes the other's bytes. Rows
without an id come last in the order. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgscreen.llm.common import blocks, mix, powers

WIDTH = 50
GRAM = 20
#: Text bytes of a chunk, and of the input per shard.
CHUNK_BYTES = 8 << 20
#: Longer texts are looked at in pieces of so many bytes (overlapping by a string less one).
PIECE = 1 << 19
#: Alphabets up to this size are sorted by induction; names beyond it by doubling their ranks.
INDUCED_ALPHABET = 1024
NO_ID = 2**63 - 1

_ONE, _TWO = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


# --- suffix arrays --------------------------------------------------------------------


def _smaller(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S-type); the end counts as smallest."""
    n = len(s)
    change = np.flatnonzero(s[:-1] != s[1:])
    following = np.searchsorted(change, np.arange(n))
    known = following < len(change)
    at = change[np.minimum(following, max(len(change) - 1, 0))] if len(change) else np.zeros(n, np.int64)
    out = np.zeros(n, bool)
    out[known] = s[at[known]] < s[at[known] + 1]
    return out


def _deal(piles: list[list], symbols: np.ndarray, rows: np.ndarray) -> None:
    """Append rows to the piles of their symbols, keeping their order."""
    if len(rows) < 2:
        for c, r in zip(symbols.tolist(), rows):
            piles[c].append(np.array([r]))
        return
    order = np.argsort(symbols, kind="stable")
    dealt, rows = symbols[order], rows[order]
    edge = np.flatnonzero(dealt[1:] != dealt[:-1]) + 1
    starts = np.concatenate(([0], edge))
    for c, part in zip(dealt[starts].tolist(), np.split(rows, edge)):
        piles[c].append(part)


def _induce(s: np.ndarray, small: np.ndarray, k: int, lms: np.ndarray) -> np.ndarray:
    """Suffix array induced from leftmost-smaller suffixes given in order: larger types forward, smaller back."""
    n = len(s)
    starts: list[list] = [[] for _ in range(k)]
    _deal(starts, s[lms], lms)
    large: list[list] = [[] for _ in range(k)]
    large[int(s[n - 1])].append(np.array([n - 1]))
    larger = ~small

    def wave(rows, wanted, c, piles):
        """Predecessors of rows that have the wanted type; those in bucket c itself are handed back."""
        before = rows[rows > 0] - 1
        before = before[wanted[before]]
        symbol = s[before]
        own = symbol == c
        if own.any():
            _deal(piles, symbol[~own], before[~own])
            return before[own]
        _deal(piles, symbol, before)
        return before[:0]

    for c in range(k):
        done, todo = [], np.concatenate(large[c]) if large[c] else np.zeros(0, np.int64)
        while len(todo):
            done.append(todo)
            todo = wave(todo, larger, c, large)
        large[c] = done
        for rows in starts[c]:
            wave(rows, larger, c, large)
    out, end = np.empty(n, np.int64), n
    lower: list[list] = [[] for _ in range(k)]
    for c in range(k - 1, -1, -1):
        todo = np.concatenate(lower[c]) if lower[c] else np.zeros(0, np.int64)
        while len(todo):
            out[end - len(todo) : end] = todo[::-1]
            end -= len(todo)
            todo = wave(todo, small, c, lower)
        rows = np.concatenate(large[c]) if large[c] else np.zeros(0, np.int64)
        out[end - len(rows) : end] = rows
        end -= len(rows)
        wave(rows[::-1], small, c, lower)
    return out


def _doubled(s: np.ndarray) -> np.ndarray:
    """Suffix array of a string over a large alphabet, by doubling the ranks of names."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] if step < n else []
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([1], 1 + np.cumsum(key[order][1:] != key[order][:-1])))
        rank[order] = new
        if new[-1] == n or step >= n:
            return order
        step *= 2


def suffix_array(s: np.ndarray, k: int) -> np.ndarray:
    """Start positions of the suffixes of ``s`` (whole numbers below ``k``) in order."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    if k > INDUCED_ALPHABET:
        return _doubled(s)
    small = _smaller(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) > 1:
        first = _induce(s, small, k, lms)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        ordered = first[is_lms[first]]
        length = np.zeros(n, np.int64)
        length[lms] = np.diff(np.append(lms, n)) + 1
        a, b = ordered[:-1], ordered[1:]
        same = (length[a] == length[b]) & (a + length[a] <= n) & (b + length[b] <= n)
        look = np.flatnonzero(same)
        depth = 0
        while len(look):
            look = look[length[a[look]] > depth]
            differ = s[a[look] + depth] != s[b[look] + depth]
            same[look[differ]] = False
            look = look[~differ]
            depth += 1
        names = np.empty(n, np.int64)
        names[ordered] = np.concatenate(([0], np.cumsum(~same)))
        count = int(names[ordered[-1]]) + 1
        if count == len(lms):
            lms = ordered
        else:
            lms = lms[suffix_array(names[lms], count)]
    return _induce(s, small, k, lms)


def common_prefixes(s: np.ndarray, order: np.ndarray, starts: np.ndarray, limit: int) -> np.ndarray:
    """For each text position the prefix shared with the suffix before it in ``order``, exact up to ``limit``.

    In text order a value falls by one a step unless the characters before the two suffixes differ; only
    those irreducible values, and those at ``starts``, are compared. ``starts`` lie closer than ``limit`` apart.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    irreducible = np.ones(n, bool)
    i = np.arange(1, n)
    prior = before[1:]
    irreducible[1:] = (prior <= 0) | (s[i - 1] != s[np.maximum(prior, 1) - 1]) | (before[:-1] != prior - 1)
    irreducible[starts] = True
    reach = 2 * limit
    text = np.concatenate((s, np.zeros(reach + 8, s.dtype)))
    at = np.flatnonzero(irreducible)
    value = np.zeros(len(at), np.int64)
    look = np.flatnonzero(before[at] >= 0)
    eight = np.lib.stride_tricks.sliding_window_view(text, 8)
    for depth in range(0, reach, 8):
        x, y = at[look] + depth, before[at[look]] + depth
        fine = (x < n) & (y < n)
        look, x, y = look[fine], x[fine], y[fine]
        if not len(look):
            break
        equal = np.ascontiguousarray(eight[x]) == np.ascontiguousarray(eight[y])
        run = np.where(equal.all(axis=1), 8, equal.argmin(axis=1))
        value[look] += run
        look = look[run == 8]
    value = np.minimum(value, n - np.maximum(at, before[at]))  # the padding behind the text matches nothing
    source = np.maximum.accumulate(np.where(irreducible, np.arange(n), 0))
    where = np.cumsum(irreducible) - 1
    return np.maximum(value[where] - (np.arange(n) - source), 0)


# --- strings, minimizers, segments ----------------------------------------------------


class Powers:
    """Powers of a base modulo 2**64, kept from block to block."""

    def __init__(self):
        self.kept: dict[int, np.ndarray] = {}

    def first(self, base: int, n: int) -> np.ndarray:
        if base not in self.kept or len(self.kept[base]) < n:
            self.kept[base] = powers(base, n + n // 4)
        return self.kept[base][:n]


class Segments:
    """Runs of ``WIDTH``-byte strings with one minimizer, over a block of pieces of texts; keys only where they are asked for."""

    def __init__(self, pieces: list[bytes], width: int, gram: int, table: Powers):
        self.blob = b"".join(pieces)
        data = np.frombuffer(self.blob, np.uint8).astype(np.uint64) + np.uint64(1)
        n = len(data)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        offsets = ends - sizes
        self.count = 0
        if n < width:
            return
        self._data, self._table = data, table
        run, down = self._first = self._sums(_ONE)
        h = mix((run[gram:] - run[:-gram]) * down[: n - gram + 1])
        bits = max(1, int(n).bit_length())
        low = (h >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(h), dtype=np.uint64)
        span, step = width - gram + 1, 1
        while step * 2 <= span:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if span > step:
            low = np.minimum(low[: len(low) - (span - step)], low[span - step :])
        position = (low & np.uint64((1 << bits) - 1)).astype(np.int64)
        piece = np.repeat(np.arange(len(pieces)), sizes)
        start = np.arange(len(position))
        inside = start + width <= ends[piece[: len(position)]]
        start, position = start[inside], position[inside]
        piece = piece[start]
        if not len(start):
            return
        fresh = np.concatenate(([True], (position[1:] != position[:-1]) | (piece[1:] != piece[:-1])))
        head = np.flatnonzero(fresh)
        self.count = len(head)
        self.piece, self.begin = piece[head], start[head]
        self.strings = np.diff(np.append(head, len(start)))
        self.stop = self.begin + self.strings + width - 1
        self.local = self.begin - offsets[self.piece]
        self.minimizer = h[position[head]]

    def _sums(self, base: int) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of the bytes times the powers of ``base``, and the powers that undo their shift."""
        n = len(self._data)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(self._data * self._table.first(base, n), dtype=np.uint64, out=run[1:])
        return run, self._table.first(pow(base, -1, 2**64), n + 1)

    def keys(self, rows: np.ndarray) -> np.ndarray:
        """Two 64-bit hashes of each of these segments."""
        begin, stop = self.begin[rows], self.stop[rows]
        out = np.empty((len(rows), 2), np.uint64)
        for j, (run, down) in enumerate((self._first, self._sums(_TWO))):
            out[:, j] = mix((run[stop] - run[begin]) * down[begin] + (stop - begin).astype(np.uint64))
        return out


class Chunk:
    """The documents of a chunk, looked at block by block."""

    def __init__(self, ids: list, texts: list[bytes], use: list[bool], width: int, gram: int):
        self.ids = np.array([NO_ID if i is None else i for i in ids], np.int64)
        self.texts, self.width, self.gram = texts, width, gram
        self.pieces = [
            (d, a) for d, t in enumerate(texts) if use[d] and len(t) >= width
            for a in range(0, len(t) - width + 1, PIECE - width + 1)
        ]

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, Segments]]:
        """(document, offset of the segment in it, segments) of each block."""
        raw, table = [self.texts[d][a : a + PIECE] for d, a in self.pieces], Powers()
        for lo, hi in blocks(raw):
            found = Segments(raw[lo:hi], self.width, self.gram, table)
            if found.count:
                doc = np.array([d for d, _ in self.pieces[lo:hi]])[found.piece]
                base = np.array([a for _, a in self.pieces[lo:hi]])[found.piece]
                yield doc, base + found.local, found


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return (mix(h + np.uint64(1)) % np.uint64(shards)).astype(np.int64)


def _sorted_unique(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows by (key, id), first row of each distinct key in it, number of the key of each row."""
    order = np.lexsort((ids, keys[:, 1], keys[:, 0]))
    k = keys[order]
    fresh = np.concatenate(([True], (k[1:] != k[:-1]).any(axis=1))) if len(k) else np.zeros(0, bool)
    number = np.empty(len(k), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return order, order[fresh], number


def shard_masks(segments: list[bytes], ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id of each string of the distinct segments, over all of them, and where each segment's strings begin."""
    blob = b"\xff".join(segments) + b"\xff"
    s = np.frombuffer(blob, np.uint8) + np.uint8(1)  # the separator, never a byte of UTF-8, becomes 0
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    order = suffix_array(s, 256)
    prefix = common_prefixes(s, order, starts, int(sizes.max()) + 1)
    strings = sizes - width + 1
    owner = np.repeat(np.arange(len(segments)), strings)
    position = np.repeat(starts, strings) + np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
    rank = np.full(len(s), -1, np.int64)
    rank[position] = np.arange(len(position))
    listed = order[rank[order] >= 0]
    # Between two strings of one group lie only strings of that group: others share less than ``width`` with them.
    fresh = prefix[listed] < width
    fresh[0] = True
    row = rank[listed]
    least = np.minimum.reduceat(ids[owner[row]], np.flatnonzero(fresh))
    out = np.empty(len(owner), np.int64)
    out[row] = least[np.cumsum(fresh) - 1]
    return out, np.concatenate(([0], np.cumsum(strings)))


# --- the distributed steps ------------------------------------------------------------


def repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges), kept (the remaining bytes) of every document."""
    if width - gram + 1 > 32 or gram >= width:
        raise ValueError("a segment's strings must fit a mask of 32 bits")
    given = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = int(given.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    n = max(16, -(-total // chunk_bytes))
    order = F.coalesce(F.col("id"), F.lit(NO_ID))
    digest = F.sha2(F.col("text"), 256)
    chunk = F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int")
    firsts = given.select(order.alias("o"), digest.alias("digest"), chunk.alias("chunk"), "id").groupBy("digest").agg(
        F.min(F.struct("o", "chunk")).alias("m")
    ).select(F.col("m.chunk").alias("chunk"), F.unhex("digest").alias("a"))
    texts = given.withColumn("chunk", chunk).repartition(n, "chunk")
    nothing = F.lit(None).cast("binary")
    firsts = firsts.select("chunk", F.lit(0).alias("kind"), "a", nothing.alias("b"))

    def read(table: pa.Table, notes: pa.Table) -> tuple[Chunk, dict[int, list]]:
        import hashlib

        ids = table.column("id").to_pylist()
        raw = [t or b"" for t in table.column("text").cast(pa.large_binary()).to_pylist()]
        kinds, a, b = (notes.column(c).to_pylist() for c in ("kind", "a", "b"))
        said: dict[int, list] = {0: [], 1: [], 2: []}
        for k, x, y in zip(kinds, a, b):
            said[k].append((x, y))
        first = {x for x, _ in said[0]}
        # The smallest id of a digest is in this chunk if the digest is listed here; other copies may be here too.
        least: dict[bytes, int] = {}
        digests = [hashlib.sha256(t).digest() for t in raw]
        for i, g in zip(ids, digests):
            least[g] = min(least.get(g, NO_ID), NO_ID if i is None else i)
        use = [g in first and (NO_ID if i is None else i) == least[g] for i, g in zip(ids, digests)]
        held = Chunk(ids, raw, use, width, gram)
        held.use = use
        return held, said

    def number_of(table: pa.Table, notes: pa.Table) -> int:
        return (table if table.num_rows else notes).column("chunk")[0].as_py()

    def by_shard(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(values, kind="stable")
        edge = np.flatnonzero(values[order][1:] != values[order][:-1]) + 1
        for rows in np.split(order, edge) if len(order) else []:
            yield int(values[rows[0]]), rows

    note = "shard int, chunk int, a binary, b binary"

    def as_notes(rows: list[tuple], names: list[str]) -> pa.Table:
        kinds = {"shard": pa.int32(), "chunk": pa.int32(), "kind": pa.int32(), "a": pa.binary(), "b": pa.binary()}
        columns = list(zip(*rows)) or [[] for _ in names]
        return pa.table([pa.array(c, kinds[x]) for c, x in zip(columns, names)], names=names)

    def send_minimizers(table: pa.Table, notes: pa.Table) -> pa.Table:
        chunk, said = read(table, notes)
        hashes, owners = [], []
        for doc, _, found in chunk.blocks():
            hashes.append(found.minimizer)
            owners.append(chunk.ids[doc])
        rows = []
        if hashes:
            h, owner = np.concatenate(hashes), np.concatenate(owners)
            order = np.lexsort((owner, h))
            h, owner = h[order], owner[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            last = np.append(first[1:], len(h)) - 1
            several = (owner[first] != owner[last]).astype(np.uint8)
            h = h[first]
            for shard, at in by_shard(_shard(h, n)):
                rows.append((shard, number_of(table, notes), h[at].tobytes(), several[at].tobytes()))
        return as_notes(rows, ["shard", "chunk", "a", "b"])

    def answer_minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches))
        chunks = got.column("chunk").to_pylist()
        lists = [np.frombuffer(x, np.uint64) for x in got.column("a").to_pylist()]
        several = np.concatenate([np.frombuffer(x, np.uint8) for x in got.column("b").to_pylist()])
        h = np.concatenate(lists)
        values, number, count = np.unique(h, return_inverse=True, return_counts=True)
        shared = count > 1
        shared[number[several > 0]] = True
        rows, at = [], 0
        for c, own in zip(chunks, lists):
            back = own[shared[number[at : at + len(own)]]]
            at += len(own)
            if len(back):
                rows.append((c, 1, back.tobytes(), None))
        yield from as_notes(rows, ["chunk", "kind", "a", "b"]).to_batches() or []

    def send_segments(table: pa.Table, notes: pa.Table) -> pa.Table:
        chunk, said = read(table, notes)
        shared = np.sort(np.frombuffer(b"".join(x for x, _ in said[1]), np.uint64))
        keys, owners, minimizers, parts = [], [], [], []
        for doc, _, found in chunk.blocks() if len(shared) else ():
            at = np.minimum(np.searchsorted(shared, found.minimizer), len(shared) - 1)
            use = np.flatnonzero(shared[at] == found.minimizer)
            # Distinct segments of the block first: most repeats are near.
            hashes = found.keys(use)
            order, firsts, _ = _sorted_unique(hashes, chunk.ids[doc[use]])
            use = use[firsts]
            keys.append(hashes[firsts])
            owners.append(chunk.ids[doc[use]])
            minimizers.append(found.minimizer[use])
            blob = found.blob
            parts += [blob[a:b] for a, b in zip(found.begin[use].tolist(), found.stop[use].tolist())]
        rows = []
        if keys:
            keys, owners, minimizers = np.concatenate(keys), np.concatenate(owners), np.concatenate(minimizers)
            _, firsts, _ = _sorted_unique(keys, owners)
            for shard, at in by_shard(_shard(minimizers[firsts], n)):
                use = firsts[at]
                head = np.array([len(use)], np.int64).tobytes() + keys[use].tobytes() + owners[use].tobytes()
                rows.append((shard, number_of(table, notes), head, b"\xff".join(parts[i] for i in use.tolist())))
        return as_notes(rows, ["shard", "chunk", "a", "b"])

    def answer_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches))
        least: dict[bytes, int] = {}
        sent = []
        for c, head, blob in zip(*(got.column(x).to_pylist() for x in ("chunk", "a", "b"))):
            m = int(np.frombuffer(head[:8], np.int64)[0])
            keys = np.frombuffer(head[8 : 8 + 16 * m], np.uint64).reshape(m, 2)
            owners = np.frombuffer(head[8 + 16 * m :], np.int64)
            texts = blob.split(b"\xff")
            sent.append((c, keys, owners, texts))
            for t, o in zip(texts, owners.tolist()):
                if o < least.get(t, NO_ID + 1):
                    least[t] = o
        segments = list(least)
        number = {t: i for i, t in enumerate(segments)}
        smallest, begin = shard_masks(segments, np.fromiter(least.values(), np.int64, len(least)), width)
        rows = []
        for c, keys, owners, texts in sent:
            at = np.fromiter(map(number.__getitem__, texts), np.int64, len(texts))
            strings = begin[at + 1] - begin[at]
            first = np.cumsum(strings) - strings
            place = np.arange(int(strings.sum())) - np.repeat(first, strings)
            later = smallest[np.repeat(begin[at], strings) + place] < np.repeat(owners, strings)
            masks = np.bitwise_or.reduceat(np.where(later, np.uint32(1) << place.astype(np.uint32), np.uint32(0)), first)
            use = np.flatnonzero(masks)
            if len(use):
                rows.append((c, 2, keys[use].tobytes(), masks[use].tobytes()))
        yield from as_notes(rows, ["chunk", "kind", "a", "b"]).to_batches() or []

    result = "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary"

    def cut(table: pa.Table, notes: pa.Table) -> pa.Table:
        chunk, said = read(table, notes)
        told = np.frombuffer(b"".join(x for x, _ in said[2]), np.uint64).reshape(-1, 2)
        masks = np.frombuffer(b"".join(y for _, y in said[2]), np.uint32)
        cover: dict[int, np.ndarray] = {}
        kept_blocks = [(doc, offset, found.keys(np.arange(found.count)), found.strings) for doc, offset, found in chunk.blocks()]
        if kept_blocks:
            doc, offset, keys, strings = (np.concatenate(x) for x in zip(*kept_blocks))
            del kept_blocks
            owner = chunk.ids[doc]
            order, firsts, number = _sorted_unique(np.concatenate((keys, told)), np.concatenate((owner, np.full(len(told), NO_ID))))
            least = np.full(len(firsts), NO_ID, np.int64)
            np.minimum.at(least, number[: len(doc)], owner)
            bits = np.zeros(len(firsts), np.uint32)
            bits[number[len(doc) :]] = masks
            every = np.left_shift(np.uint64(1), strings.astype(np.uint64)) - np.uint64(1)
            gone = np.where(owner > least[number[: len(doc)]], every.astype(np.uint32), bits[number[: len(doc)]])
            for i in np.flatnonzero(gone).tolist():
                d, mask = int(doc[i]), int(gone[i])
                line = cover.get(d)
                if line is None:
                    line = cover[d] = np.zeros(len(chunk.texts[d]) + 1, np.int32)
                if mask == int(every[i]):
                    line[offset[i]] += 1
                    line[offset[i] + strings[i] + width - 1] -= 1
                    continue
                for j in range(int(strings[i])):
                    if mask >> j & 1:
                        line[offset[i] + j] += 1
                        line[offset[i] + j + width] -= 1
        out: list[list] = [[], [], [], []]
        for d, t in enumerate(chunk.texts):
            spans, kept = [], t
            if not chunk.use[d] and len(t) >= width:
                spans, kept = [{"start": 0, "stop": len(t)}], b""
            elif d in cover:
                hit = np.concatenate(([False], np.cumsum(cover[d][:-1]) > 0, [False]))
                edge = np.flatnonzero(hit[1:] != hit[:-1])
                spans = [{"start": a, "stop": b} for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist())]
                kept = np.frombuffer(t, np.uint8)[~hit[1:-1]].tobytes()
            for column, value in zip(out, (None if chunk.ids[d] == NO_ID else int(chunk.ids[d]), len(t), spans, kept)):
                column.append(value)
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), span, pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "n_bytes", "spans", "kept"])

    def at_chunks(notes: DataFrame, work, schema: str) -> DataFrame:
        return texts.groupBy("chunk").cogroup(notes.groupBy("chunk")).applyInArrow(work, schema)

    back = "chunk int, kind int, a binary, b binary"
    shared = at_chunks(firsts, send_minimizers, note).groupBy("shard").applyInArrow(answer_minimizers, back)
    masks = at_chunks(firsts.unionAll(shared), send_segments, note).groupBy("shard").applyInArrow(answer_segments, back)
    return at_chunks(firsts.unionAll(masks), cut, result)
