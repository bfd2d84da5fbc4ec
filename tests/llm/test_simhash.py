"""SimHash fingerprints, BK-trees and components against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from msgscreen.llm import common, simhash_bk

from . import brute
from .test_exact import passage, rows


def near_copies():
    rng = random.Random(4)
    words = passage(11, 150).split()
    made = [(100 + i, " ".join(words[:k] + [f"w{i}"] + words[k + 1 :])) for i, k in enumerate(rng.choices(range(150), k=80))]
    return made + [(300 + i, passage(300 + i, 20)) for i in range(60)] + [(400, "A b"), (401, "a  B"), (402, "a"), (403, "a b c")]


def test_fingerprints(monkeypatch):
    texts = [t for _, t in rows() + near_copies()]
    for text in texts:
        assert simhash_bk.fingerprint((text or "").encode()) == brute.simhash(text)
    monkeypatch.setattr(simhash_bk, "pieces", lambda t: common.pieces(t, 9))
    for text in texts[:40]:
        assert simhash_bk.fingerprint((text or "").encode()) == brute.simhash(text)


def test_hash_is_the_one_of_spark(spark):
    import xxhash

    texts = ["", "a", "one two three", "é ü ß 🙂" * 9]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()
    assert [r[0] % 2**64 for r in got] == [xxhash.xxh64(t.encode(), seed=42).intdigest() for t in texts]


def test_tree_finds_all_pairs_and_visits_few(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    flips = [base ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for _ in range(5)]
    values = np.unique(np.concatenate([base, *flips]))
    query, node = simhash_bk.BKTree(values).within(values, 2)
    want = {(i, j) for i, a in enumerate(values.tolist()) for j, b in enumerate(values.tolist()) if bin(a ^ b).count("1") <= 2}
    assert set(zip(query.tolist(), node.tolist())) == want and len(query) == len(want) > len(values)
    seen = []
    count = np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: seen.append(len(x)) or count(x))
    tree = simhash_bk.BKTree(values)
    seen.clear()
    tree.within(values, 2)
    assert sum(seen) < 0.7 * len(values) ** 2


@pytest.mark.parametrize(("shard", "piece"), [(256, 512), (4, 3)])
def test_components(spark, shard, piece):
    made = rows() + near_copies()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in made], "doc_id bigint, text string, fp int, comp string").repartition(3)
    got = simhash_bk.linked(docs, shard=shard, piece=piece).collect()
    want = brute.simhash_components(made)
    assert sorted(map(tuple, got), key=str) == want
    assert len({c for _, _, c in want}) < len(made) - 20


def test_wider_radius(spark):
    made = near_copies()
    got = simhash_bk.linked(spark.createDataFrame(made, "doc_id bigint, text string"), radius=6, shard=8).collect()
    assert sorted(map(tuple, got), key=str) == brute.simhash_components(made, 6)


def test_empty(spark):
    assert simhash_bk.linked(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
