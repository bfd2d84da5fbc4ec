"""Periodic runs against a plain search of every period."""

import random

import pytest

from msgscreen.llm import common, periodic

from . import brute


def made(rng):
    """Words of repeated blocks, cut short, mixed with noise and copies of themselves."""
    words = []
    for _ in range(rng.randint(1, 5)):
        letters = rng.choice([1, 2, 3, 30])
        unit = [rng.randrange(letters) for _ in range(rng.randint(1, 14))]
        words += unit * rng.randint(1, 9) + unit[: rng.randint(0, len(unit))]
        if rng.random() < 0.5:
            words += [rng.randrange(letters) for _ in range(rng.randint(0, 20))]
        if rng.random() < 0.3:
            words += words[: rng.randint(0, len(words))]
    return [b"w%d" % w for w in words]


def test_runs_of_random_words():
    rng = random.Random(5)
    found = 0
    for _ in range(300):
        words = made(rng)
        ranges = periodic.stretches([b"other", b" ".join(words)])[1]
        got = periodic.judged(words, ranges) if ranges else []
        want = brute.runs(words)
        assert got == want
        found += len(want)
        dropped = {i for s, e, q in want for i in range(s + q, e)}
        assert periodic.kept_words(words, got) == [w for i, w in enumerate(words) if i not in dropped]
    assert found > 300


def test_grammar_derives_its_words_and_repeats_no_pair():
    rng = random.Random(2)
    for _ in range(100):
        words = [rng.randrange(4) for _ in range(rng.randint(1, 80))]
        grammar = periodic.Grammar(words)

        def derived(symbol):
            if symbol < grammar.base:
                return [symbol]
            return derived(grammar.left[symbol - grammar.base]) + derived(grammar.right[symbol - grammar.base])

        rest = [grammar.rest[k] for k in sorted(grammar.rest)]
        assert [w for s in rest for w in derived(s)] == words
        pairs, end = [], {}
        for i, pair in enumerate(zip(rest, rest[1:])):
            if end.get(pair, -1) < i:  # "aaa" holds one pair
                pairs.append(pair)
                end[pair] = i + 1
        assert len(pairs) == len(set(pairs))


def test_long_text_is_cut_into_pieces(monkeypatch):
    words = [b"x%d" % (i % 40) for i in range(9000)] + [b"y" * 50_000] + [b"z"] * 30
    text = b" \n".join(words)
    assert b"".join(common.pieces(text, 1000)) == text
    monkeypatch.setattr(periodic, "pieces", lambda t: common.pieces(t, 1000))
    ranges = periodic.stretches([text])[0]
    assert periodic.judged(words, ranges) == [(0, 9000, 40), (9001, 9031, 1)]


LINE = "one two three four five six seven eight "
ROWS = [
    (1, LINE * 3), (2, LINE * 2), (3, None), (4, ""), (5, " \t\n"), (6, ("ha " * 23).strip()), (7, " ha " * 24), (8, "a b " * 5000),
    (9, LINE * 4 + "break " + LINE * 5), (9, LINE * 4 + "break " + LINE * 5), (None, "no\x0bid " * 12), (10, ("q " * 30 + "r ") * 3),
]


@pytest.mark.parametrize("batch", ["2", "10000"])
def test_frame(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        docs = spark.createDataFrame([(i, t, "x") for i, t in ROWS], "doc_id bigint, text string, runs string").repartition(2)
        got = periodic.with_runs(docs, out="found").select("doc_id", "text", "runs", "found.n_words", "found.runs", "found.collapsed").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(ROWS)
    for doc_id, text, clash, n, runs, collapsed in got:
        words = brute.WORD.findall(text or "")
        want = brute.runs(words)
        dropped = {i for s, e, q in want for i in range(s + q, e)}
        assert clash == "x" and n == len(words)
        assert [(r.start, r.start + r.length, r.period) for r in runs] == want
        assert collapsed == " ".join(w for i, w in enumerate(words) if i not in dropped)


def test_empty_frame(spark):
    assert periodic.with_runs(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_other_bounds():
    rng = random.Random(8)
    for _ in range(60):
        words = made(rng)
        ranges = periodic.stretches([b" ".join(words)], 12, 4)[0]
        assert (periodic.judged(words, ranges, 12, 4) if ranges else []) == brute.runs(words, 12, 4)
