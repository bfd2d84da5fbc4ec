"""Language-model scores from Elias-Fano n-gram tries (order 3), built and queried in shards.

Probability of a word w after u v: (1 - g3) * c(u v w) / c(u v) + g3 * p2(w), with p2 = (1 - g2) * c(v w) / c(v) +
g2 * p1(w), where p1 is the add-one unigram probability, and the weights g3 and g2 depend on the size classes of
c(u v) and c(v). A weight is the share of tokens whose n-gram occurs once in the whole training text (leave-one-out
estimate of unseen successors): shards sum singletons and tokens by size class over their merged counts, Spark adds
the sums up, and the score step applies the weights. The first word of a text has only the text's beginning before it.

A shard owns a range of first words and keeps their n-grams as a trie whose levels are files mapped into memory:
* contexts, sorted, and the shard's words, sorted: Elias-Fano sequences;
* for each level, pointers from contexts to their successors: a monotone Elias-Fano sequence;
* successors, as word numbers counted from the context's own base, so that a whole level is monotone;
* the counts, exact below 2**15 and above it to 1/1024 of an octave.
A query finds context and word, then searches the successor among those of the context only. Where it is stands
for the context one level down.

Chunks of documents send their distinct words, bigrams and trigrams with training counts, packed, to shards and get
counts back in the order sent; texts move by one shuffle. Contexts of more than a fraction of a
shard's load (at most 8 a shard, found in the first pass with their counts) are split over all shards by
successor, and so are pairs of two such words: a pair is no more frequent than either. Shards and chunks grow
in number with the input, not in size.

Null and empty texts are the end token alone. Repeated rows count as often as they occur. Rows without an
id are scored like others. Without training text every token has the probability 1.
"""

from __future__ import annotations

import os
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgscreen.llm.common import BLANK, BLOCK_BYTES, LOWER, Words, blocks, encoded, freed_shuffles, mix

CHUNK_BYTES = 8 << 20
BEGIN, END = np.uint64(1), np.uint64(2)
#: Counts below EXACT are their own code; an octave above it has STEP codes.
EXACT, STEP = 1 << 15, 1024
CLASSES = 64
_BYTE_RANK = np.array([[(v >> b) & 1 for b in range(8)] for v in range(256)], np.uint8)
_BYTE_COUNT = _BYTE_RANK.sum(axis=1).astype(np.int64)
#: Place of the r-th set bit of a byte.
_BYTE_SELECT = np.array([[([b for b in range(8) if v >> b & 1] + [0] * 8)[r] for r in range(8)] for v in range(256)], np.int64)


def _searched(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """``searchsorted``, in the order of what is wanted: from one place to a near one."""
    if not (wanted[1:] < wanted[:-1]).any():
        return np.searchsorted(values, wanted)
    order = np.argsort(wanted)
    out = np.empty(len(wanted), np.int64)
    out[order] = np.searchsorted(values, wanted[order])
    return out


class EliasFano:
    """Non-decreasing uint64 values: packed low bits, unary high bits, both mapped from files."""

    def __init__(self, folder: str, name: str, values: np.ndarray):
        values = values.astype(np.uint64)
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.low_bits = max(0, (top // max(1, self.n)).bit_length() - 1)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64) + np.arange(self.n)
        size = (int(high[-1]) if self.n else 0) // 8 + 1
        bits = np.zeros(size * 8, bool)
        bits[high] = True
        unary = np.packbits(bits, bitorder="little")
        at = np.arange(self.n, dtype=np.uint64) * np.uint64(self.low_bits)
        words = np.zeros(self.n * self.low_bits // 64 + 2, np.uint64)
        if self.low_bits:
            low = values & np.uint64((1 << self.low_bits) - 1)
            place, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            if self.n:
                first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
                words[place[first]] = np.bitwise_or.reduceat(low << shift, first)
            over = shift + np.uint64(self.low_bits) > 64  # one value of a word at most
            words[place[over] + 1] |= low[over] >> (np.uint64(64) - shift[over])
        before = np.concatenate(([0], np.cumsum(_BYTE_COUNT[unary])))
        self.parts = {}
        for part, array in (("high", unary), ("low", words), ("rank", before)):
            path = os.path.join(folder, f"{name}.{part}.npy")
            np.save(path, array)
            self.parts[part] = np.load(path, mmap_mode="r")

    def whole(self) -> np.ndarray:
        """All values in one pass over the bits."""
        high = np.flatnonzero(np.unpackbits(self.parts["high"], bitorder="little")) - np.arange(self.n)
        return self._with_low(high, np.arange(self.n))

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        if len(i) * 4 >= self.n:  # a pass is cheaper than so many single values
            return self.whole()[i]
        rank = self.parts["rank"]
        byte = np.searchsorted(rank, i, side="right") - 1
        return self._with_low(byte * 8 + _BYTE_SELECT[self.parts["high"][byte], i - rank[byte]] - i, i)

    def _with_low(self, high: np.ndarray, i: np.ndarray) -> np.ndarray:
        value = high.astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            at = i.astype(np.uint64) * np.uint64(self.low_bits)
            place, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            low = self.parts["low"][place] >> shift
            over = shift > 0
            low[over] |= self.parts["low"][place[over] + 1] << (np.uint64(64) - shift[over])
            value |= low & np.uint64((1 << self.low_bits) - 1)
        return value

    def find(self, wanted: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Place of each wanted value between lo and hi, -1 where it is not there."""
        lo = np.zeros(len(wanted), np.int64) if lo is None else lo.copy()
        hi = np.full(len(wanted), self.n, np.int64) if hi is None else hi.copy()
        end = hi.copy()
        if len(wanted) * 8 >= self.n:
            values = self.whole()
            lo = np.clip(_searched(values, wanted), lo, hi)
            out = np.full(len(wanted), -1, np.int64)
            maybe = np.flatnonzero(lo < end)
            same = values[lo[maybe]] == wanted[maybe]
            out[maybe[same]] = lo[maybe[same]]
            return out
        look = np.flatnonzero(lo < hi)
        while len(look):
            mid = (lo[look] + hi[look]) >> 1
            below = self[mid] < wanted[look]
            lo[look[below]] = mid[below] + 1
            hi[look[~below]] = mid[~below]
            look = look[lo[look] < hi[look]]
        out = np.full(len(wanted), -1, np.int64)
        maybe = np.flatnonzero(lo < end)
        same = self[lo[maybe]] == wanted[maybe]
        out[maybe[same]] = lo[maybe[same]]
        return out


class Level:
    """One level of a trie: distinct (place of the context, word) sorted, with quantised counts."""

    def __init__(self, folder: str, name: str, n_contexts: int, place: np.ndarray, word: np.ndarray, words: EliasFano, code: np.ndarray):
        self.n_contexts, self.words = n_contexts, words
        self.pointers = EliasFano(folder, f"{name}.pointers", np.searchsorted(place, np.arange(n_contexts + 1)))
        self.successors = EliasFano(folder, f"{name}.successors", self._wanted(place, words.find(word)))
        path = os.path.join(folder, f"{name}.codes.npy")
        np.save(path, code.astype(np.uint16))
        self.codes = np.load(path, mmap_mode="r")

    def _wanted(self, place: np.ndarray, number: np.ndarray) -> np.ndarray:
        return place.astype(np.uint64) * np.uint64(max(1, self.words.n)) + number.astype(np.uint64)

    def find(self, place: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places of the words after contexts at ``place``, -1 where the n-gram does not occur."""
        out = np.full(len(word), -1, np.int64)
        number = self.words.find(word)
        use = np.flatnonzero((place >= 0) & (number >= 0))
        place, number = place[use], number[use]
        out[use] = self.successors.find(self._wanted(place, number), self.pointers[place].astype(np.int64), self.pointers[place + 1].astype(np.int64))
        return out

    def codes_at(self, place: np.ndarray) -> np.ndarray:
        out = np.zeros(len(place), np.uint16)
        out[place >= 0] = self.codes[place[place >= 0]]
        return out


class Trie:
    """N-grams of a shard: distinct (context, word) sorted, and below them (number of the pair, word) sorted."""

    def __init__(self, folder: str, context: np.ndarray, word: np.ndarray, count: np.ndarray, below: tuple[np.ndarray, np.ndarray, np.ndarray]):
        pair, last, often = below
        contexts, place = np.unique(context, return_inverse=True)
        self.contexts = EliasFano(folder, "contexts", contexts)
        every = np.sort(np.concatenate([word, last]))  # np.unique hashes first, which takes longer
        words = EliasFano(folder, "words", every[np.append(every[1:] != every[:-1], [True] * bool(len(every)))])
        self.second = Level(folder, "second", len(contexts), place, word, words, quantised(count))
        self.third = Level(folder, "third", len(context), pair, last, words, quantised(often))

    def places_of(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self.second.find(self.contexts.find(context), word)


# --- tokens ---------------------------------------------------------------------------


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, context, word) of every token, the end of each text among them."""
    docs, contexts, words, base = [], [], [], 0
    for a, b in blocks(texts, BLOCK_BYTES // 4):
        found = Words([t.translate(LOWER) for t in texts[a:b]], BLANK == 0)
        h = found.hash | np.uint64(4)  # never BEGIN or END
        ends = np.cumsum(found.counts)
        words.append(np.insert(h, ends, END))
        contexts.append(np.insert(h, ends - found.counts, BEGIN))
        docs.append((base + np.insert(found.doc, ends, np.arange(b - a))).astype(np.int32))
        base += b - a
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(contexts), np.concatenate(words)


def size_class(count: np.ndarray) -> np.ndarray:
    return np.frexp(np.maximum(count, 1).astype(float))[1].astype(np.int64) - 1


def quantised(count: np.ndarray) -> np.ndarray:
    """Codes of counts in two bytes; a count and its code are of one size class."""
    part, power = np.frexp(np.maximum(count, 1).astype(float))
    step = np.minimum(np.floor(np.log2(2 * part) * STEP), STEP - 1)
    code = EXACT + (power - 16) * STEP + step
    return np.where(count < EXACT, count, np.minimum(code, 0xFFFF)).astype(np.uint16)


def restored(code: np.ndarray) -> np.ndarray:
    over = np.maximum(code.astype(np.int64) - EXACT, 0)
    return np.where(code < EXACT, code, EXACT * 2.0 ** ((over + 0.5) / STEP))


def weights_of(once: np.ndarray, every: np.ndarray) -> np.ndarray:
    """Weight of each size class, falling with the size; ``once`` of its ``every`` tokens are of single n-grams."""
    weights, last = np.ones(CLASSES), 1.0
    for k in range(CLASSES):
        if every[k] > 0:
            last = min(last, max((once[k] + 0.5) / (every[k] + 1), 1e-3))
        weights[k] = min(last, 0.999)
    return weights


def pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context * np.uint64(0x9FB21C651E98DF25) + word)


def _shard(h: np.ndarray, n: int) -> np.ndarray:
    return (mix(h + np.uint64(7)) % np.uint64(n)).astype(np.int64)


def _runs(values: np.ndarray) -> Iterator[tuple[int, slice]]:
    edge = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if b > a:
            yield int(values[a]), slice(a, b)


def _within(order: np.ndarray) -> np.ndarray:
    """The place of each row in the order."""
    out = np.empty(len(order), np.int32 if len(order) < 1 << 31 else np.int64)
    out[order] = np.arange(len(order), dtype=out.dtype)
    return out


def _stable(key: np.ndarray) -> np.ndarray:
    """The stable order of whole numbers: numpy's plain sorts, several times faster, with ties put right."""
    if len(key) < 2 or len(key) >= 1 << 31:
        return np.argsort(key, kind="stable")
    order = np.argsort(key)
    held = key[order]
    run = np.zeros(len(key), np.uint64)
    np.cumsum(held[1:] != held[:-1], out=run[1:])
    run <<= np.uint64(32)
    run |= order.astype(np.uint64)
    run.sort()
    run &= np.uint64(0xFFFFFFFF)
    return run.astype(np.int64)


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a place of each, and the number of every given key; any of several places."""
    order = np.argsort(key)
    held = key[order]
    new = np.ones(len(key), bool)
    np.not_equal(held[1:], held[:-1], out=new[1:])
    at = np.empty(len(key), np.int32 if len(key) < 1 << 31 else np.int64)
    at[order] = np.cumsum(new, dtype=at.dtype) - 1
    return held[new], order[new], at


def _order(place: np.ndarray, word: np.ndarray) -> np.ndarray:
    """By place, then by the bytes of the word that are sent."""
    if not len(place) or int(place.max()) >> (64 - 8 * WORD_BYTES):
        return np.lexsort((word, place))
    key = place.astype(np.uint64) << np.uint64(8 * WORD_BYTES) | word >> np.uint64(64 - 8 * WORD_BYTES)
    return _stable(key)  # every task that orders the same rows gets the same order


class ChunkCounts:
    """Distinct words and bigrams of a chunk in the order in which they are sent to shards."""

    def __init__(self, texts: list[bytes], train: np.ndarray, shards: int, hot: np.ndarray):
        self.doc, self.context, self.word = tokens(texts)
        use = train[self.doc] if len(self.doc) else np.zeros(0, bool)
        values, self.word_at = np.unique(self.word, return_inverse=True)
        shard = _shard(values, shards)
        order = np.lexsort((values, shard))
        self.word_at = np.argsort(order)[self.word_at] if len(order) else self.word_at
        self.words, self.word_shard = values[order], shard[order]
        self.word_count = np.bincount(self.word_at[use], minlength=len(values))
        pair = pair_key(self.context, self.word)
        keys, first, at = _distinct(pair)
        context, word = self.context[first], self.word[first]
        split = np.isin(context, hot)
        shard = np.where(split, _shard(keys, shards), _shard(context, shards))
        if shards <= 1 << 16:  # contexts are told apart by the bytes that are sent
            order = _stable(shard.astype(np.uint64) << np.uint64(48) | context >> np.uint64(16))
        else:
            order = np.lexsort((context, shard))
        self.pair_at = _within(order)[at]
        self.pairs = context[order], word[order]
        self.pair_shard = shard[order]
        self.pair_count = np.bincount(self.pair_at[use], minlength=len(keys))
        del values, keys, first, at, context, word, split, shard, order  # the trigrams take as much again
        # Trigrams, by the place of the pair that begins them; those of two frequent words travel on their own.
        self.third = np.flatnonzero(self.context != BEGIN)
        keys, first, at = _distinct(pair_key(pair[self.third - 1], self.word[self.third]))
        first = self.third[first]
        place, word, key = self.pair_at[first - 1], self.word[first], pair[first - 1]
        loose = np.isin(self.context[first - 1], hot) & np.isin(self.context[first], hot)
        shard = np.where(loose, _shard(keys, shards), self.pair_shard[place])
        nested, free = np.flatnonzero(~loose), np.flatnonzero(loose)  # places of pairs go by shard
        order = np.concatenate([nested[_order(place[nested], word[nested])], free[np.lexsort((word[free], key[free], shard[free]))]])
        self.triple_at = _within(order)[at]
        self.triples = place[order], key[order], word[order]
        self.triple_shard, self.n_nested = shard[order], int((~loose).sum())
        self.triple_count = np.bincount(self.triple_at[use[self.third]], minlength=len(keys))


#: Bytes of a hash that are sent: enough to tell the contexts of a shard, and the successors of a context, apart.
CONTEXT_BYTES, WORD_BYTES = 6, 5


def _short(hashes: np.ndarray, size: int) -> bytes:
    """The upper bytes of the hashes."""
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, 8 - size :]).tobytes()


def _long(raw: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, 8 - size :] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return out.view(np.uint64).ravel()


def _rising(hashes: np.ndarray, size: int) -> bytes:
    """The upper bytes of hashes that mostly rise: steps from one to the next, byte by byte, the two upper ones deflated."""
    steps = np.diff(hashes >> np.uint64(64 - 8 * size), prepend=np.uint64(0))  # a fall wraps around
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :size].T)
    upper = zlib.compress(planes[size - 2 :].tobytes(), 1)
    return np.array([len(hashes), len(upper)], np.uint32).tobytes() + upper + planes[: size - 2].tobytes()


def _risen(raw: bytes, size: int) -> tuple[np.ndarray, bytes]:
    """The hashes, and what follows them."""
    n, m = np.frombuffer(raw[:8], np.uint32).tolist()
    end = 8 + m + n * (size - 2)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, size - 2 : size] = np.frombuffer(zlib.decompress(raw[8 : 8 + m]), np.uint8).reshape(2, n).T
    steps[:, : size - 2] = np.frombuffer(raw[8 + m : end], np.uint8).reshape(size - 2, n).T
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64) << np.uint64(64 - 8 * size), raw[end:]


def _small(counts: np.ndarray) -> bytes:
    """Counts in one byte each; 255 and more follow in full."""
    large = counts >= 255
    packed = zlib.compress(np.where(large, 255, counts).astype(np.uint8).tobytes(), 1)
    return np.int64(len(packed)).tobytes() + packed + counts[large].astype(np.int64).tobytes()


def _large(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    counts = np.frombuffer(zlib.decompress(raw[8 : 8 + n]), np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw[8 + n :], np.int64)
    return counts


def _listed(words: np.ndarray) -> bytes:
    """Words as numbers into a list of the distinct ones, the most frequent first; numbers byte by byte, deflated."""
    values, at, often = np.unique(words >> np.uint64(64 - 8 * WORD_BYTES), return_inverse=True, return_counts=True)
    order = np.argsort(-often, kind="stable")
    number = _within(order)[at].astype(np.uint32)
    wide = 2 if len(values) <= 1 << 16 else 4
    planes = np.ascontiguousarray(number.view(np.uint8).reshape(-1, 4)[:, :wide].T)
    return _rising(values[order] << np.uint64(64 - 8 * WORD_BYTES), WORD_BYTES) + zlib.compress(planes.tobytes(), 1)


def _unlisted(raw: bytes) -> np.ndarray:
    values, planes = _risen(raw, WORD_BYTES)
    planes = np.frombuffer(zlib.decompress(planes), np.uint8).reshape(2 if len(values) <= 1 << 16 else 4, -1)
    number = np.zeros((planes.shape[1], 4), np.uint8)
    number[:, : len(planes)] = planes.T
    return values[number.view(np.uint32).ravel()]


def _merged(context: np.ndarray, word: np.ndarray, seen: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """Distinct (context, word) in order, their summed counts, and the place of every given pair among them."""
    order = _order(context if context.dtype != np.uint64 else np.unique(context, return_inverse=True)[1], word)
    c, w = context[order], word[order]
    if not len(order):
        return (c, w), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (w[1:] != w[:-1]))))
    at = np.empty(len(order), np.int32 if len(order) < 1 << 31 else np.int64)
    at[order] = np.repeat(np.arange(len(first), dtype=at.dtype), np.diff(np.append(first, len(order))))
    return (c[first], w[first]), np.add.reduceat(seen[order].astype(np.int64), first), at


def _sums(kind: np.ndarray, count: np.ndarray) -> np.ndarray:
    """N-grams seen once, and tokens, by the size class of the context."""
    return np.stack([np.bincount(kind, x, minlength=CLASSES)[:CLASSES].astype(np.int64) for x in (count == 1, count)])


# --- the two passes -------------------------------------------------------------------


def _first_pass(given: DataFrame, shards: int, cut: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Training tokens, distinct ones, words seen ``cut`` times or more with counts."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoded(batch.column("text"))
            for a, b in blocks(texts, 2 * CHUNK_BYTES):
                values, count = np.unique(tokens(texts[a:b])[2], return_counts=True)
                shard = _shard(values, shards)
                order = np.argsort(shard, kind="stable")
                rows = [(s, values[order[r]].tobytes(), _small(count[order[r]])) for s, r in _runs(shard[order])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["shard", "a", "b"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches))
        a, b = (got.column(c).to_pylist() for c in ("a", "b"))
        values, at = np.unique(np.frombuffer(b"".join(a), np.uint64), return_inverse=True)
        count = np.bincount(at, np.concatenate([_large(x) for x in b]), minlength=len(values)).astype(np.int64)
        hot = count >= cut
        row = (int(count.sum()), len(values), values[hot].tobytes(), count[hot].tobytes())
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], ["n", "v", "a", "b"])

    with freed_shuffles(given.sparkSession):
        counted = given.where("train").select("text").mapInArrow(local, "shard int, a binary, b binary")
        rows = counted.groupBy("shard").applyInArrow(reduce, "n bigint, v bigint, a binary, b binary").collect()  # at most 8 words a shard
    hot = np.frombuffer(b"".join(r["a"] for r in rows), np.uint64)
    counts = np.frombuffer(b"".join(r["b"] for r in rows), np.int64)
    return sum(r["n"] for r in rows), sum(r["v"] for r in rows), hot, counts


def scored(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score of every document."""
    given = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    total = int(given.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    n = max(16, -(-total // chunk_bytes))
    n_train, n_distinct, hot, hot_counts = _first_pass(given, n, max(2, total // (16 * n)))
    hot_counts = np.append(hot_counts[np.argsort(hot)], 0)
    hot = np.append(np.sort(hot), BEGIN)
    order = np.argsort(hot)
    hot, hot_counts = hot[order], hot_counts[order]
    # Texts begin as often as they end.
    ends = hot_counts[hot == END]
    hot_counts[hot == BEGIN] = ends[0] if len(ends) else -1
    if not len(ends):  # fewer texts than the cut: they are no hot context either
        hot, hot_counts = hot[hot != BEGIN], hot_counts[hot != BEGIN]
    texts = given.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int")).repartition(n, "chunk")
    note = "shard int, chunk int, kind int, a binary, b binary, c binary, d binary, e binary, f binary"

    def counts_of(table: pa.Table) -> ChunkCounts:
        raw = [t or b"" for t in table.column("text").cast(pa.large_binary()).to_pylist()]
        return ChunkCounts(raw, table.column("train").to_numpy(), n, hot)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        chunk, held = table.column("chunk")[0].as_py(), counts_of(table)
        rows = []
        for s, r in _runs(held.word_shard):
            rows.append((s, chunk, 1, _rising(held.words[r], 8), _small(held.word_count[r]), *[None] * 4))
        context, word = held.pairs
        place, key, last = held.triples
        for s, r in _runs(held.pair_shard):
            own = context[r]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            size = np.diff(np.append(first, len(own)))
            a, b = np.searchsorted(place[: held.n_nested], (r.start, r.stop))
            below = np.bincount(place[a:b] - r.start, minlength=r.stop - r.start)
            rows.append((s, chunk, 2, _rising(own[first], CONTEXT_BYTES), _small(size), _listed(np.concatenate([word[r], last[a:b]])), _small(held.pair_count[r]),
                         _small(below), _small(held.triple_count[a:b])))
        for s, r in _runs(held.triple_shard[held.n_nested :]):
            r = slice(r.start + held.n_nested, r.stop + held.n_nested)
            rows.append((s, chunk, 3, key[r].tobytes(), None, _listed(last[r]), _small(held.triple_count[r]), *[None] * 2))
        kinds = (pa.int32(),) * 3 + (pa.binary(),) * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["shard", "chunk", "kind", *"abcdef"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        shard = table.column("shard")[0].as_py()
        rows = list(zip(*(table.column(c).to_pylist() for c in ("chunk", "kind", *"abcdef"))))
        del table
        out = []
        asked = [r for r in rows if r[1] == 1]
        if asked:
            words = [_risen(r[2], 8)[0] for r in asked]
            values, at = np.unique(np.concatenate(words), return_inverse=True)
            count = np.bincount(at, np.concatenate([_large(r[3]) for r in asked]), minlength=len(values)).astype(np.int64)
            back = np.split(count[at], np.cumsum([len(x) for x in words])[:-1])
            out += [(r[0], 1, shard, _small(b)) for r, b in zip(asked, back)]
        sums = np.zeros((4, CLASSES), np.int64)
        asked = [r for r in rows if r[1] == 2]
        if asked:
            context = np.concatenate([np.repeat(_risen(r[2], CONTEXT_BYTES)[0], _large(r[3])) for r in asked])
            seen, deeper = ([_large(r[k]) for r in asked] for k in (5, 7))
            parts = [np.split(_unlisted(r[4]), [len(x)]) for r, x in zip(asked, seen)]
            word, last = (np.concatenate(x) for x in zip(*parts))
            ends = [np.cumsum([len(x) for x in counts])[:-1] for counts in (seen, deeper)]
            (c, w), count, at = _merged(context, word, np.concatenate(seen))
            owner, of = np.unique(c, return_inverse=True)
            whole = np.bincount(of, count, minlength=len(owner))
            short = _long(_short(hot, CONTEXT_BYTES), CONTEXT_BYTES)  # in the same order
            place = np.minimum(np.searchsorted(short, owner), max(len(hot) - 1, 0))
            if len(hot):
                known = short[place] == owner
                whole[known] = hot_counts[place[known]]
            below = np.repeat(at, np.concatenate([_large(r[6]) for r in asked]))
            (pair, x), often, at3 = _merged(below, last, np.concatenate(deeper))
            del seen, deeper, parts, context, word, last, below
            sums[:2] = _sums(size_class(whole[of]), count)
            sums[2:] = _sums(size_class(count[pair]), often)
            trained, deep = count > 0, often > 0
            with tempfile.TemporaryDirectory() as folder:
                if trained.any():
                    number = np.cumsum(trained) - 1
                    trie = Trie(folder, c[trained], w[trained], count[trained], (number[pair[deep]], x[deep], often[deep]))
                    places = trie.places_of(c, w)
                    second, third = trie.second.codes_at(places)[at], trie.third.codes_at(trie.third.find(places[pair], x))[at3]
                    del trie
                else:
                    second, third = np.zeros(len(at), np.uint16), np.zeros(len(at3), np.uint16)
            for kind, answers, cut in ((2, second, ends[0]), (3, third, ends[1])):
                out += [(r[0], kind, shard, _small(b)) for r, b in zip(asked, np.split(answers, cut))]
        asked = [r for r in rows if r[1] == 3]
        if asked:
            context = np.concatenate([np.frombuffer(r[2], np.uint64) for r in asked])
            word = np.concatenate([_unlisted(r[4]) for r in asked])
            (c, w), count, at = _merged(context, word, np.concatenate([_large(r[5]) for r in asked]))
            # How often the pair occurs in all is known to the chunks' other shards: the sums go by pair.
            owner, of = np.unique(c, return_inverse=True)
            split = [np.bincount(of, x, minlength=len(owner)).astype(np.int64) for x in (count == 1, count)]
            out.append((shard % n, 6, shard, np.stack([owner.view(np.int64), *split]).tobytes()))
            trained = count > 0
            with tempfile.TemporaryDirectory() as folder:
                if trained.any():
                    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
                    trie = Trie(folder, c[trained], w[trained], count[trained], none)
                    answers = trie.second.codes_at(trie.places_of(c, w))[at]
                    del trie
                else:
                    answers = np.zeros(len(at), np.uint16)
            back = np.split(answers, np.cumsum([len(r[2]) // 8 for r in asked])[:-1])
            out += [(r[0], 4, shard, _small(b)) for r, b in zip(asked, back)]
        out.append((shard % n, 5, shard, sums.tobytes()))  # to any chunk
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["chunk", "kind", "shard", "a"])

    result_types = [("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                    ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    result = "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, CLASSES), np.int64)
        names = ["class", "pair", "once", "every"]
        for batch in batches:
            kind, a = batch.column("kind"), batch.column("a")
            for x in a.filter(pc.equal(kind, 5)).to_pylist():
                held += np.frombuffer(x, np.int64).reshape(4, CLASSES)
            for x in a.filter(pc.equal(kind, 6)).to_pylist():
                pair, once, every = np.frombuffer(x, np.int64).reshape(3, -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), -1)), pa.array(pair), pa.array(once), pa.array(every)], names)
        both = [pa.array(np.concatenate([held[k], held[k + 2]])) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * CLASSES)), pa.array(np.zeros(2 * CLASSES, np.int64)), *both], names)

    def score(table: pa.Table, notes: pa.Table) -> pa.Table:
        m = table.num_rows
        if not m:  # a chunk without texts has only sums
            return pa.table([[]] * len(result_types), schema=pa.schema(result_types))
        held = counts_of(table)
        sums = np.zeros((2, 2 * CLASSES))
        for r in table.column("sums")[0].as_py():
            sums[:, r["class"]] = r["once"], r["every"]
        weights, deep = (weights_of(*sums[:, k : k + CLASSES]) for k in (0, CLASSES))
        said = sorted(zip(*(notes.column(c).to_pylist() for c in ("kind", "shard", "a"))), key=lambda r: r[:2])
        none = [np.zeros(0, np.int64)]
        count, code, nested, loose = (np.concatenate(none + [_large(a) for k, _, a in said if k == kind]) for kind in (1, 2, 3, 4))
        single = (count + 1) / (n_train + n_distinct + 1)
        of_word = count[held.word_at]
        # A context is the word before; a text's beginning counts as often as the end.
        end = count[np.flatnonzero(held.words == END)] if len(held.words) else np.zeros(1)
        before = np.concatenate(([0], of_word[:-1])) if len(of_word) else of_word
        before = np.where(held.context == BEGIN, end[0] if len(end) else 0, before)
        g = np.where(before > 0, weights[size_class(before)], 1.0)
        p1 = single[held.word_at]
        pairs = restored(code[held.pair_at])
        p = (1 - g) * np.minimum(pairs / np.maximum(before, 1), 1) + g * p1
        before = pairs[held.third - 1]
        g = np.where(before > 0, deep[size_class(before)], 1.0)
        often = restored(np.concatenate([nested, loose])[held.triple_at])
        p[held.third] = (1 - g) * np.minimum(often / np.maximum(before, 1), 1) + g * p[held.third]
        del before, g, pairs, often, code, nested, loose
        by_doc = lambda x: np.bincount(held.doc, x, minlength=m)
        columns = [
            pa.array(table.column("id").to_pylist(), pa.int64()), pa.array(table.column("train").to_pylist(), pa.bool_()),
            pa.array(np.bincount(held.doc, minlength=m), pa.int64()), pa.array(by_doc(of_word > 0).astype(np.int64), pa.int64()),
            pa.array([n_train] * m, pa.int64()), pa.array(by_doc(np.log10(p1))), pa.array(by_doc(np.log10(p))),
        ]
        return pa.table(columns, schema=pa.schema(result_types))

    # The shuffle of the replies is used twice: for the sums, and for the scores.
    replies = texts.groupBy("chunk").applyInArrow(send, note).groupBy("shard").applyInArrow(answer, "chunk int, kind int, shard int, a binary").repartition(n, "chunk")
    # Pairs of two frequent words have their singletons in many shards; what they add up to gives the pair's class.
    parts = replies.mapInArrow(sums_of, "class bigint, pair bigint, once bigint, every bigint").groupBy("class", "pair")
    added = parts.agg(F.sum("once").alias("once"), F.sum("every").alias("every"))
    own = F.length(F.bin(F.greatest("every", F.lit(1).cast("bigint")))) - 1 + CLASSES
    by_class = added.groupBy(F.when(F.col("class") < 0, own).otherwise(F.col("class")).cast("bigint").alias("class")).agg(F.sum("once").alias("once"), F.sum("every").alias("every"))
    sums = by_class.agg(F.collect_list(F.struct("class", "once", "every")).alias("sums"))
    return texts.crossJoin(F.broadcast(sums)).groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(score, result)
