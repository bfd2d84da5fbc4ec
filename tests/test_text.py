"""Text expressions against plain Python on random Unicode text."""

import random
import re

from pyspark.sql import functions as F

from msgscreen.functions import text


def sample_texts(n=1500, seed=7):
    rng = random.Random(seed)
    pools = [
        "abcdefXYZ0129", " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　", "éÉßçœÄ", "حسابك توثيق", "😀中文ΣΑΣ", ".,;:!?'\"-_/@#{}[]",
    ]
    return ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def test_matches_python(spark):
    texts = sample_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    rows = df.select(
        "id", text.normalise(F.col("t")).alias("norm"), text.tokens(F.col("t")).alias("tok"),
        text.strip(F.col("t")).alias("strip"), F.length("t").alias("len"),
        text.validation_error(F.col("t")).alias("err"), text.preview(F.col("t"), 8).alias("pre"),
    ).collect()
    for row in rows:
        t = texts[row.id]
        assert row.norm == re.sub(r"\s+", " ", t.lower()).strip(), repr(t)
        assert row.tok == t.split(), repr(t)
        assert row.strip == t.strip(), repr(t)
        assert row.len == len(t)
        assert row.err == ("empty" if not t.strip() else "too_short" if len(t.strip()) < 5 else None)
        assert row.pre == t[:8] + ("..." if len(t) > 8 else "")


def test_term_counts(spark):
    from collections import Counter

    texts = [" ".join(random.Random(i).choices("a b c dd ee", k=i)) for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for row in df.select("id", text.term_counts(text.tokens(F.col("t"))).alias("c")).collect():
        assert {c.term: c.tf for c in row.c} == dict(Counter(texts[row.id].split()))


def test_goldens(spark):
    rows = [("  A  B\n", "a b"), ("a b c　d", "a b c d"), ("Hi, 2 You!", "hi, 2 you!")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert all(r.got == r.want for r in df.select("want", text.normalise(F.col("t")).alias("got")).collect())
    checks = [("", "empty"), ("    ", "empty"), ("abcd", "too_short"), ("abcde", None), ("a😀b", "too_short"), (None, "empty")]
    df = spark.createDataFrame(checks, "t string, want string")
    assert all(r.got == r.want for r in df.select("want", text.validation_error(F.col("t")).alias("got")).collect())
