"""Shared pieces of the training-text operators: byte blocks, word hashes, chunked groups, folds."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from msgscreen.scale import remove, scratch_path

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: ASCII white space: what ``bytes.split()`` splits on, the complement of ``[^\x20\x09-\x0D]``.
BLANK = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
#: Lower-cased letters, digits and every byte of a multi-byte character.
ALNUM = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])

_BLANKS = re.compile(rb"[\x20\x09-\x0D]")
_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of text handled by one numpy pass; longer single texts make a pass of their own.
BLOCK_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64, so that order and low bits look random."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts whose joined size stays near ``limit`` bytes."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def pieces(text: bytes, limit: int = BLOCK_BYTES) -> Iterator[bytes]:
    """A long text cut at white space into parts of about ``limit`` bytes, so that one numpy pass stays bounded."""
    start = 0
    while len(text) - start > limit:
        cut = _BLANKS.search(text, start + limit)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class Words:
    """The words of a block of texts: byte ranges, number of the text, 64-bit hash."""

    def __init__(self, texts: list[bytes], is_word: np.ndarray, seed: int = 0):
        self.blob = b"\n".join(texts) + b"\n"
        data = np.frombuffer(self.blob, np.uint8)
        inside = np.concatenate(([False], is_word[data]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edge[0::2], edge[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        self.doc = np.searchsorted(self.offsets, self.starts, side="right") - 1
        self.counts = np.bincount(self.doc, minlength=len(texts))
        n = len(data)
        up = powers(_BASE + 2 * seed, n + 1)
        down = powers(pow(_BASE + 2 * seed, -1, 2**64), n + 1)
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)))
        length = (self.ends - self.starts).astype(np.uint64)
        self.hash = mix((run[self.ends] - run[self.starts]) * down[self.starts] + length)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``size`` words inside one text."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for j in range(size):
            h = h * np.uint64(0xD6E8FEB86659FD93) + self.hash[j : j + n]
        first = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        return first, mix(h[first])

    def bytes_of(self, first: int, size: int) -> bytes:
        """Words joined by one blank."""
        blob, s, e = self.blob, self.starts, self.ends
        return b" ".join(blob[s[i] : e[i]] for i in range(first, first + size))


def encoded(values) -> list[bytes]:
    """UTF-8 bytes of an Arrow string array; null counts as empty."""
    import pyarrow as pa

    if len(values) == 0:
        return []
    return [b"" if v is None else v for v in values.cast(pa.large_binary()).to_pylist()]


def text_blocks(values, limit: int = BLOCK_BYTES // 4) -> Iterator[list[bytes]]:
    """The texts of an Arrow string array as lists of about ``limit`` bytes, of which a task holds one at a time."""
    import pyarrow.compute as pc

    if len(values) == 0:
        return
    sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    part = (np.cumsum(sizes) - sizes) // limit
    edge = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(sizes)])).tolist()
    for a, b in zip(edge[:-1], edge[1:]):
        yield encoded(values.slice(a, b - a))


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def scratch(spark: SparkSession, purpose: str) -> str:
    return scratch_path(spark, f"llm-{purpose}")


#: Spark gives the shuffles of an execution back when it has ended (from 4.1 on; older versions pass over the name).
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is planned and run in here gives its shuffles back."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


class Tables:
    """Steps of one run, each written once to the shared folder; what no later step reads is deleted."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.folder, self.paths, self.n = spark, scratch(spark, purpose), {}, 0

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` as a stored table, which replaces the one put before under this name."""
        self.n += 1
        path = f"{self.folder}/{name}-{self.n}"
        with freed_shuffles(self.spark):
            df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                remove(self.spark, self.paths.pop(name))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)
