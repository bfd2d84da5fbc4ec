"""Samples by threshold, compacted registry, vectors by content, long word lists, history pages, arriving pages."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from msgscreen import schema
from msgscreen.functions.url import lexicon_hits
from msgscreen.operators import chunking, registry, sampling
from msgscreen.operators.embed import HashingEncoder
from msgscreen.operators.long_lexicon import long_lexicon_hits
from msgscreen.scale import remove
from msgscreen.sources import registry_store, vectors
from msgscreen.streaming import arrivals


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_threshold_sample_is_the_ranked_one(spark, digits):
    rows = [(i, "ab"[i % 7 == 0] if i % 11 else None) for i in range(4000)] + [(i, "few") for i in range(9000, 9004)]
    df = spark.createDataFrame(rows, "doc_id long, label string")
    for n in (1, 5, 300, 3000, 99_999):
        key = lambda r: (r.label, r.doc_id)
        ranked = sorted(df.where("label IS NOT NULL").withColumn("k", sampling.draw_key("doc_id")).collect(), key=lambda r: (r.label, r.k, r.doc_id))
        taken = {}
        for r in ranked:
            taken.setdefault(r.label, []).append(r.doc_id)
        want = sorted((c, i) for c, ids in taken.items() for i in ids[:n])
        assert sorted(map(key, sampling.threshold_sample(df, n, digits=digits).collect())) == want
    assert sampling.stratified_sample(df, 2000).count() == sampling.threshold_sample(df, 2000).count()


def test_large_samples_rank_one_range_only(spark):
    df = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit("all").alias("label"))
    sample = sampling.stratified_sample(df, 5000)
    assert sample.count() == 5000
    plan = sample._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.rindex("Window [row_number()") :]
    assert "(_range" in window and "= _edge" in window  # what is ranked was cut to the edge's range first


LOG = "name string, pages long, added_at timestamp_ntz, path string, op string, seq long"


def operations(n, start=0):
    rng = random.Random(start)
    return [(f"d{rng.randrange(20)}", i, dt.datetime(2025, 1, 1) + dt.timedelta(hours=start + i), "p", rng.choice(["upsert"] * 3 + ["delete"]), start + i) for i in range(n)]


def listed(log):
    return sorted(map(tuple, registry.listing(log).collect()))


def test_registry_snapshots(spark, tmp_path, monkeypatch):
    path, every = str(tmp_path), []
    assert listed(registry_store.load(spark, path)) == []
    assert registry_store.compact(spark, path) == 1
    for version in range(6):
        rows = operations(30, 100 * version)
        every += rows
        registry_store.append(spark.createDataFrame(rows, LOG), path, version)
        if version % 2:
            registry_store.compact(spark, path)
            registry_store.vacuum(spark, path)
        assert listed(registry_store.load(spark, path)) == listed(spark.createDataFrame(every, LOG))
    # A log of any length is read as one snapshot: a row a name.
    assert registry_store.load(spark, path).count() <= 20
    assert registry_store.snapshots(spark, path) == [4] and not [v for _, _, f in os.walk(f"{path}/log") for v in f if v.endswith(".parquet")]

    rows = operations(30, 900)
    every += rows
    registry_store.append(spark.createDataFrame(rows, LOG), path, 9)
    real, calls = registry.latest, []

    def broken(log):
        calls.append(1)
        raise RuntimeError("lost")

    monkeypatch.setattr(registry, "latest", broken)
    with pytest.raises(RuntimeError):
        registry_store.compact(spark, path)
    monkeypatch.setattr(registry, "latest", real)
    # Rows without the list of covered folders are no snapshot either.
    spark.createDataFrame([], schema.REGISTRY_LOG).write.parquet(f"{path}/snapshots/5/rows")
    assert listed(registry_store.load(spark, path)) == listed(spark.createDataFrame(every, LOG))
    assert registry_store.compact(spark, path) == 5
    assert listed(registry_store.load(spark, path)) == listed(spark.createDataFrame(every, LOG))
    assert registry_store.status(spark, path).first().n == len(listed(spark.createDataFrame(every, LOG)))


def test_texts_are_encoded_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i % 30}") for i in range(100)] + [(200, None), (201, "")], "doc_id long, text string")
    encoder = HashingEncoder(16)
    seen = []

    class Counting(HashingEncoder):
        def encode(self, df, text, out="embedding", keep=None):
            seen.append(df.count())
            return encoder.encode(df, text, out, keep)

    counting = Counting(16)
    first = vectors.encode_once(docs.where("doc_id < 20"), counting, str(tmp_path))
    assert first.count() == 20
    again = vectors.encode_once(docs, counting, str(tmp_path))
    assert seen == [20, 11]  # 30 texts and the empty one, less the 20 known
    want = {r.doc_id: r.embedding for r in encoder.encode(docs, "text").collect()}
    assert {r.doc_id: r.embedding for r in again.collect()} == want and again.columns == ["doc_id", "text", "embedding"]
    assert vectors.encode_once(docs, counting, str(tmp_path)).count() == 102 and seen == [20, 11, 0]
    other = vectors.encode_once(docs, HashingEncoder(8), str(tmp_path))
    assert len(other.first().embedding) == 8


def test_long_lexicon(spark):
    rng = random.Random(4)
    letters = "abcé-"
    words = ["".join(rng.choices(letters, k=rng.randrange(1, 8))) for _ in range(400)]
    texts = ["".join(rng.choices(letters + "ABC ", k=rng.randrange(0, 40))) for _ in range(120)] + [None, "", words[0]]
    lexicon = spark.createDataFrame([(i, w) for i, w in enumerate(words)] + [(1000, ""), (1001, None), (1002, words[3])], "pos long, word string")
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = sorted(map(tuple, long_lexicon_hits(frame, lexicon).collect()))
    known = [(i, w) for i, w in enumerate(words)] + [(1000, ""), (1002, words[3])]
    want = sorted((i, p, w) for i, t in enumerate(texts) if t is not None for p, w in known if w in t.lower())
    assert got == want
    few = frame.select("id", F.explode(lexicon_hits(F.col("text"), words[:40])).alias("w")).collect()
    assert sorted((r.id, r.w) for r in few) == sorted((i, w) for i, p, w in want if p < 40)
    plan = long_lexicon_hits(frame, lexicon)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000  # no expression a word


def test_newest_history(spark, tmp_path):
    rows = [(dt.datetime(2025, 1, 1) + dt.timedelta(hours=7 * i), i, f"text {i}", "phishing", "low") for i in range(300)] + [(None, 900, "undated", "x", "low")]
    log = spark.createDataFrame(rows, "ts timestamp_ntz, seq long, text string, label string, risk_level string")
    path = str(tmp_path / "log")
    assert arrivals.newest_history(spark, path, 5).collect() == []
    for version in range(3):
        arrivals.append_history_days(log.where(F.coalesce("seq", F.lit(0)) % 3 == version), path, version)
    arrivals.append_history_days(log.where("seq % 3 = 1"), path, 1)  # a replay replaces itself
    got = [r.seq for r in arrivals.newest_history(spark, path, 40).collect()]
    assert got == list(range(299, 259, -1))
    assert [r.seq for r in arrivals.newest_history(spark, path, 1000).collect()] == [*range(299, -1, -1), 900]
    read = arrivals.newest_history(spark, path, 10).inputFiles()
    assert {f.split("day=")[1].split("/")[0] for f in read} <= {"2025-03-29", "2025-03-28", "2025-03-27", "2025-03-26"}
    remove(spark, f"{path}/day=2025-01-05")
    assert len(arrivals.newest_history(spark, path, 40).collect()) == 40


def test_pages_in_odd_order(spark, tmp_path):
    rng = random.Random(1)
    pages = [(f"doc{d}", p, " ".join(rng.choices(["alpha", "beta", "gamma\n"], k=rng.randrange(0, 120))), 6) for d in range(9) for p in range(6)]
    pages += [("short", 0, "tiny", 1), ("open", 0, "words " * 40, 3), ("open", 2, "words " * 40, 3), ("null", 0, None, 2), ("null", 1, "more words " * 20, 2)]
    rng.shuffle(pages)
    kind = "name string, page_no long, text string, n_pages long"
    folder = f"{tmp_path}/pages"
    for i in range(5):
        again = pages[: 7 * (i == 4)]  # the last batch repeats some pages
        spark.createDataFrame(pages[i::5] + again, kind).coalesce(1).write.parquet(f"{folder}/batch={i}")

    def run(batches):
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{folder}/batch=*")
        stored = lambda: spark.read.schema(kind).parquet(*[f"{folder}/batch={i}" for i in range(batches)])
        arrivals.ingest_pages(stream, stored, f"{tmp_path}/kb", f"{tmp_path}/checkpoint", HashingEncoder(8)).awaitTermination()
        return arrivals.load_chunks(spark, f"{tmp_path}/kb")

    got = run(5)
    whole = spark.createDataFrame([p for p in pages if p[0] != "open"], kind)
    want = chunking.chunk_pages(whole.drop("n_pages"))
    key = ["source_name", "chunk_id", "chunk"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))
    assert {r.name for r in registry.active(arrivals.load_registry(spark, f"{tmp_path}/kb/registry")).collect()} == {p[0] for p in pages} - {"open"}
    spark.createDataFrame([("open", 1, "words " * 40, 3)], kind).coalesce(1).write.parquet(f"{folder}/batch=5")
    later = run(6)
    assert later.where("source_name = 'open'").count() == 2 and later.count() == got.where("source_name <> 'open'").count() + 2


def test_stored_postings_are_lists(spark, tmp_path):
    """A row of the stored postings is a list of neighbouring documents; what is read from them are single postings."""
    from msgscreen.functions.text import term_counts, tokens
    from msgscreen.operators import lexical
    from msgscreen.sources import index as stored_index

    texts = [(i, f"common Éa éa w{i % 3} w{i % 3} x{i}") for i in range(40)] + [(None, "common lost"), (90, None), (91, " "), (7, "common twice")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    plain = docs.select("doc_id", tokens(F.lower(F.coalesce("text", F.lit("")))).alias("t")).select("doc_id", F.size("t").alias("dl"), term_counts(F.col("t")).alias("terms"))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(lexical.build_doc_terms(docs)) == key(plain)
    stored_index.save_lexical_index(docs, str(tmp_path))
    got = stored_index.load_lexical_index(spark, str(tmp_path))
    assert key(got.postings) == key(lexical.postings_of(plain))
    assert key(got.term_stats.select("term", "df")) == key(lexical.document_frequencies(plain))
    rows = spark.read.parquet(f"{tmp_path}/posting_blocks").where("term = 'common'")
    assert rows.count() < rows.agg(F.sum("n")).first()[0] == 42


def test_pages_are_counted_in_shared_states(spark, tmp_path):
    """Many documents share a state; each is reported once, in the batch that brings its last page."""
    kind = "name string, page_no long, n_pages long"
    batches = [[(f"d{i}", 0, 2) for i in range(1500)] + [("long", 70, 2), (None, 0, 1)], [(f"d{i}", 1, 2) for i in range(0, 1500, 2)] + [("d1", 0, 2), ("long", 1, 2)], [(f"d{i}", p, 2) for i in range(1500) for p in range(2)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/pages/batch={i}")
    told = []
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/pages/batch=*")
    writer = arrivals.complete_documents(stream).writeStream.foreachBatch(lambda batch, version: told.append(sorted(map(tuple, batch.collect()))))
    query = writer.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    even, odd = ([(f"d{i}", 2) for i in range(a, 1500, 2)] for a in (0, 1))
    assert [t for t in told if t] == [sorted([*even, ("long", 2)]), sorted(odd)]
    assert max(states) <= arrivals.COUNT_GROUPS < 1500
