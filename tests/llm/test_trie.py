"""The prefix trie against one that builds every prefix."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from msgscreen.llm import prefix_trie, queries

from . import brute


def conversations():
    """Shared starts, copies, long ones, null and repeated turns, conversations without a base."""
    rng = random.Random(6)
    says = ["hello", "yes", "no", "tell me more", "é🙂", "", None]
    made = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(says)) for c in range(260) if c not in (100,) for t in range(rng.randint(1, 7))]
    made += [(300 + c, t, "user", f"line {t}") for c in range(40) for t in range(9)]
    made += [(400 + c, t, "user", f"turn {t}") for c in range(3) for t in range(30 + c)]
    made += [(500, None, "user", "first of all"), (500, 1, "user", "b"), (500, 1, "user", "a"), (500, 1, "user", "a"), (500, 0, None, None)]
    return made + [(None, 0, "user", "nobody")] * 3


def answer(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("conversations"))
    made = [(*r, 1, "x") for r in conversations()]
    frame = spark.createDataFrame(made, "conv_id bigint, turn int, role string, text string, size int, digest string")
    frame.repartition(3).write.parquet(f"{path}/conversations.parquet")
    return path


def test_query(spark, table):
    assert answer(queries.QUERIES["op12_prefix_trie"](spark, table)) == brute.trie(brute.rebuilt(conversations()))


def sequences(spark, texts):
    """Turns and ids as ``trie`` takes them."""
    rows = [(c, d + 1, bytearray(t.encode()), len(t)) for c, turns in texts.items() for d, t in enumerate(turns)]
    turns = spark.createDataFrame(rows, "conv_id bigint, depth bigint, digest binary, size bigint").repartition(3)
    return turns, spark.createDataFrame([(c,) for c in texts], "conv_id bigint")


@pytest.mark.parametrize(("span", "rows", "turns"), [(512, 65536, 1 << 19), (3, 4, 7), (2, 1, 1), (512, 5, 30)])
def test_segments_and_blocks(spark, span, rows, turns):
    rng = random.Random(9)
    texts = {c: [rng.choice("ab") * rng.randint(1, 2) for _ in range(rng.choice([0, 1, 2, 3, 5, 7]))] for c in range(120)}
    texts |= {1000 + c: ["same", "words", "again", "and", "again"] for c in range(25)} | {2000: ["same"], 2001: ["x"] * 11, 2002: ["x"] * 11, 2003: []}
    got = prefix_trie.trie(*sequences(spark, texts), span=span, rows_bound=rows, turns_bound=turns)
    assert answer(got) == brute.trie({c: [("", t) for t in v] for c, v in texts.items()})


def test_one_conversation_over_many_parts(spark):
    """A conversation that holds nearly all turns is numbered in pieces."""
    made = [(7, t, "user", f"t{t % 5}") for t in range(3000)] + [(8, t, "user", f"t{t}") for t in range(3)]
    frame = spark.createDataFrame(made, "conv_id bigint, turn int, role string, text string").repartition(6)
    turns, parts = prefix_trie.numbered(frame)
    numbers = turns.join(parts, ["conv_id", "part"]).select("conv_id", (F.col("place") - F.col("first") + F.col("before")).alias("n"))
    assert sorted(map(tuple, numbers.collect())) == sorted((c, t) for c, t, _, _ in made)


def test_minima():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 100):
        values = rng.integers(-1, 5, n)
        table = prefix_trie.Minima(values)
        row, bound = np.repeat(np.arange(n), 6), np.tile(np.arange(6), n)
        left, right = table.left_extent(row, bound), table.right_extent(row, bound)
        for i, d, a, b in zip(row, bound, left, right):
            assert a == max((j for j in range(1, i + 1) if values[j] < d), default=0)
            assert b == min((j - 1 for j in range(i + 1, n) if values[j] < d), default=n - 1)
        last = np.minimum(row + bound, n - 1)
        assert table.least(row, last).tolist() == [values[a : b + 1].min() for a, b in zip(row, last)]


def test_empty(spark, tmp_path):
    frame = spark.createDataFrame([], "conv_id bigint, turn int, role string, text string")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.QUERIES["op12_prefix_trie"](spark, str(tmp_path)).collect() == []
