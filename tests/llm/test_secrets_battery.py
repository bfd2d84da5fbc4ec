"""The randomness battery against a plain version of it, and its cost on long tokens."""

import base64
import random
import string
import time

from pyspark.sql import functions as F

from msgscreen.llm import secrets

from . import brute

RNG = random.Random(12)


def drawn(letters, n):
    return "".join(RNG.choices(letters, k=n))


def spans(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = secrets.scanned(frame, out="found").select("doc_id", F.filter("found.spans", lambda s: s["kind"] == 3).alias("s")).collect()
    return {r.doc_id: [(s.start, s.stop) for s in r.s] for r in rows}


def test_rates():
    assert round(secrets.change_rate(secrets.UPPER + secrets.LOWER + secrets.DIGITS + "+/"), 4) == 0.6445
    assert secrets.change_rate(secrets.LOWER) == 0 and round(secrets.change_rate("0123456789abcdef"), 4) == 0.4688


def test_battery_equals_the_plain_one(spark):
    alphabets = [string.ascii_lowercase, string.ascii_letters, string.hexdigits[:16], string.ascii_uppercase + "234567", string.digits,
                 string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_", "ab", "aA1", string.ascii_lowercase + string.digits]
    texts = [None, "", "plain words only, of no length", "x" * 60, "ab" * 40, "internationalisationalisation donaudampfschifffahrtsgesellschaft"]
    for letters in alphabets:
        texts += [f"one {drawn(letters, n)} two" for n in (20, 24, 32, 40, 64, 200)]
        texts.append(" ".join(drawn(letters, RNG.randrange(20, 70)) for _ in range(6)) + " some_long_identifier_of_a_program")
    texts.append("key " + base64.b64encode(RNG.randbytes(40)).decode())
    got = spans(spark, texts)
    for i, text in enumerate(texts):
        assert got[i] == brute.random_tokens(text), text
    assert sum(bool(v) for v in got.values()) > 25


def test_behaviour_does_not_turn_with_length(spark):
    both = string.ascii_letters + string.digits + "+/"
    texts = [f"a {drawn(both, n)} b" for n in (40, 1000, 10_000)] + [f"a {drawn(string.ascii_lowercase, 64)} b", f"a {drawn(string.digits, 64)} b"]
    assert [len(v) for v in spans(spark, texts).values()] == [1, 1, 1, 1, 0]


def test_long_tokens_cost_in_proportion(spark):
    letters = string.ascii_letters + string.digits + "+/"
    spans(spark, ["warm " + drawn(letters, 100)])
    start = time.perf_counter()
    assert spans(spark, [f"data:{drawn(letters, 1_000_000)} end"]) == {0: [(5, 1_000_005)]}
    assert time.perf_counter() - start < 120


def test_plan_holds_the_battery_once(spark):
    """A value that is used more than once is bound, not written out: the plan holds each shape test once."""
    frame = spark.createDataFrame([(1, "text")], "doc_id bigint, text string")
    plan = secrets.masked(secrets.scanned(frame))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[A-Z2-7]") == 1
