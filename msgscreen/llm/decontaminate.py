"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned past by every training text.

Test items are cut into windows of ``size`` consecutive normalised words (an item of fewer words is one
window). The windows' hashes are broadcast after their bytes were summed and found below
``BROADCAST_BYTES``; a larger test set is worked off in parts of that size, each with its own scan.
A hash hit is verified word by word, so results never depend on hash collisions. The scan is a
projection: no shuffle, and a common passage costs its own documents only.

Nulls: a null or empty text or item has no words and is hit by nothing; a null item id takes no part.
Repeated items count once per id, repeated documents are scanned alike, an empty test set hits nothing.
Other columns of the documents pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgscreen.llm.common import ALNUM, LOWER, Words, encoded, scratch, text_blocks

WINDOW_WORDS = 10
#: Largest test set, in bytes of its texts, that one broadcast carries. A window keeps its words and
#: hash, about 10 x the text, so tasks hold at most some 100 MB of it.
BROADCAST_BYTES = 8 << 20

HITS = "struct<n_words:bigint,n_hit:bigint,item_ids:array<string>,spans:array<struct<start:bigint,stop:bigint>>>"
_HITS = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
])


class TestSet:
    """Windows of a bounded part of the test items, ready for lookups."""

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        words = Words([t.translate(LOWER) for _, t in items], ALNUM)
        self.windows: dict[bytes, set] = {}
        self.hashes, self.filters = {}, {}
        lengths = np.minimum(words.counts, size)
        for n in sorted(set(lengths.tolist()) - {0}):
            first, h = words.windows(n)
            own = lengths[words.doc[first]] == n
            for i in first[own].tolist():
                self.windows.setdefault(words.bytes_of(i, n), set()).add(items[words.doc[i]][0])
            self.hashes[n] = np.unique(h[own])
            table = np.zeros(1 << 20, bool)
            table[(self.hashes[n] & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.filters[n] = table

    def scan(self, texts: list[bytes]) -> list[dict]:
        words = Words([t.translate(LOWER) for t in texts], ALNUM)
        cover = np.zeros(len(words.hash) + 1, np.int64)
        items: dict[int, set] = {}
        for n, hashes in self.hashes.items():
            first, h = words.windows(n)
            maybe = np.flatnonzero(self.filters[n][(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
            for i in first[maybe[hashes[at] == h[maybe]]].tolist():
                owners = self.windows.get(words.bytes_of(i, n))
                if owners:
                    cover[i] += 1
                    cover[i + n] -= 1
                    items.setdefault(int(words.doc[i]), set()).update(owners)
        hit = np.cumsum(cover[:-1]) > 0
        n_hit = np.bincount(words.doc[hit], minlength=len(texts))
        out = [{"n_words": int(a), "n_hit": int(b), "item_ids": [], "spans": []} for a, b in zip(words.counts, n_hit)]
        for d, owners in items.items():
            out[d]["item_ids"] = sorted(owners)
        where = np.flatnonzero(hit)
        if len(where):
            doc = words.doc[where]
            cut = np.flatnonzero((np.diff(where) > 1) | (np.diff(doc) > 0)) + 1
            for run in np.split(np.arange(len(where)), cut):
                d, a, b = int(doc[run[0]]), where[run[0]], where[run[-1]]
                base = words.offsets[d]
                out[d]["spans"].append({"start": int(words.starts[a] - base), "stop": int(words.ends[b] - base)})
        return out


def _scanner(test_set):
    @F.arrow_udf(HITS)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = TestSet(*test_set.value)
        for values in batches:
            for texts in text_blocks(values):
                yield pa.array(held.scan(texts), _HITS)

    return scan


def _merged(parts: list[str]) -> tuple[Column, Column]:
    """One verdict of the verdicts of several parts of a test set."""
    items = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"{p}.item_ids") for p in parts]))))
    spans = F.array_sort(F.flatten(F.array(*[F.col(f"{p}.spans") for p in parts])))
    return items, spans


def contaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    size: int = WINDOW_WORDS, out: str = "hits", bound: int = BROADCAST_BYTES,
) -> DataFrame:
    """``docs`` with a struct ``out``: words, hit words, ids of the items, hit byte ranges of the UTF-8 text."""
    spark = docs.sparkSession
    given = items.where(F.col(item_id).isNotNull()).select(
        F.col(item_id).cast("string").alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("t")
    )
    total = given.agg(F.sum(F.octet_length("t") + 32)).first()[0] or 0
    n_parts = max(1, -(-int(total) // bound))
    parted = given.withColumn("part", F.pmod(F.xxhash64("id", "t"), F.lit(n_parts)))
    if n_parts == 1:
        rows = parted.select("id", "t").distinct().collect()  # at most ``bound`` bytes
        return docs.withColumn(out, _scanner(spark.sparkContext.broadcast(_packed(rows, size)))(F.col(text)))
    # A scan for each part, one after the other: tasks of one scan hold one part only.
    step = docs
    for k in range(n_parts):
        rows = parted.where(F.col("part") == k).select("id", "t").distinct().collect()
        held = spark.sparkContext.broadcast(_packed(rows, size))
        step = step.withColumn(f"__part_{k}", _scanner(held)(F.col(text)))
        path = scratch(spark, "decontaminate")
        step.write.parquet(path)
        step = spark.read.parquet(path)
    parts = [f"__part_{k}" for k in range(n_parts)]
    ids, spans = _merged(parts)
    whole = F.struct(F.col(f"{parts[0]}.n_words").alias("n_words"), ids.alias("item_ids"), spans.alias("spans"))
    return step.withColumn(out, F.arrow_udf(_joined, HITS)(F.col(text), whole)).drop(*parts)


def _packed(rows, size: int) -> tuple[list[tuple[str, bytes]], int]:
    return [(r["id"], r["t"].encode()) for r in rows], size


def _joined(text: pa.Array, whole: pa.Array) -> pa.Array:
    """Union of byte ranges that several parts found, words in it counted again."""
    found = []
    for t, w in zip(encoded(text), whole.to_pylist()):
        runs: list[list[int]] = []
        for s in w["spans"]:
            if runs and s["start"] <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], s["stop"])
            else:
                runs.append([s["start"], s["stop"]])
        words = Words([t.translate(LOWER)], ALNUM)
        inside = np.zeros(len(words.starts), bool)
        for a, b in runs:
            inside |= (words.starts >= a) & (words.ends <= b)
        spans = []
        at = np.flatnonzero(inside)
        for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []:
            spans.append({"start": int(words.starts[run[0]]), "stop": int(words.ends[run[-1]])})
        found.append({"n_words": w["n_words"], "n_hit": int(inside.sum()), "item_ids": w["item_ids"], "spans": spans})
    return pa.array(found, _HITS)


def without_spans(docs: DataFrame, text: str = "text", hits: str = "hits") -> DataFrame:
    """Hit byte ranges cut out of the texts; a null text stays null."""
    return docs.withColumn(text, F.arrow_udf(_cut, "string")(F.col(text), F.col(hits)))


def _cut(text: pa.Array, hits: pa.Array) -> pa.Array:
    out = []
    for t, h in zip(text.to_pylist(), hits.to_pylist()):
        if t is None:
            out.append(None)
            continue
        raw, kept, at = t.encode(), [], 0
        for s in h["spans"]:
            kept.append(raw[at : s["start"]])
            at = s["stop"]
        out.append(b"".join([*kept, raw[at:]]).decode())
    return pa.array(out, pa.string())
