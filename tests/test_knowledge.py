import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from msgscreen import schema
from msgscreen.operators import chunking, context, registry, sampling
from msgscreen.operators.embed import HashingEncoder
from msgscreen.operators.lexical import build_lexical_index
from msgscreen.plans import retrieve, screen
from msgscreen.sources import corpus as source
from msgscreen.sources import index as stored
from msgscreen.streaming import arrivals

ENCODER = HashingEncoder(16, "md5")


def chunk_python(text, size=500):
    flat = text.replace("\n", " ").strip()
    return [c for c in (flat[i : i + size] for i in range(0, len(flat), size)) if len(c) > 50]


def test_chunk_counts(spark):
    sizes = {0: 0, 50: 0, 51: 1, 550: 1, 551: 2, 1050: 2, 1051: 3}
    df = spark.createDataFrame([(str(n), "\n " + "é" * n + " \t") for n in sizes], "source_name string, text string")
    got = {r[0]: r[1] for r in chunking.chunk_documents(df).groupBy("source_name").count().collect()}
    assert {n: got.get(str(n), 0) for n in sizes} == sizes


def test_chunk_pages_equals_chunks_of_assembled(spark):
    rng = random.Random(9)

    def page():
        return "".join(rng.choice("ab é\n😀 \t　") for _ in range(rng.choice([0, 1, 3, 40, 700, 1600])))

    docs = {f"d{i}.pdf": [page() for _ in range(rng.randrange(1, 40))] for i in range(12)}
    docs["blank.pdf"] = ["\n", "  ", ""]
    docs["lead.pdf"] = ["\n\n", " \t", "x" * 120, " " * 700, "y" * 60, "\n"]
    rows = [(name, i, t) for name, pages in docs.items() for i, t in enumerate(pages)]
    pages = spark.createDataFrame(rows, schema.DOC_PAGES)
    want = {(n, i): c for n, ps in docs.items() for i, c in enumerate(chunk_python("".join(p + "\n" for p in ps)))}
    for block in (4, 1024):
        got = {(r.source_name, r.chunk_id): r.chunk for r in chunking.chunk_pages(pages, pages_per_block=block).collect()}
        assert got == want
    whole = {r.name: r.text for r in chunking.assemble_pages(pages).collect()}
    assert whole == {n: "".join(p + "\n" for p in ps) for n, ps in docs.items()}


def test_long_documents_and_null_pages(spark):
    rows = [("long.pdf", i, None if i % 7 == 0 else f"page {i} text") for i in range(1, 2500)]
    pages = spark.createDataFrame(rows + [("nulls.pdf", 0, None), ("nulls.pdf", 1, "z" * 60), ("nulls.pdf", 2, None)], schema.DOC_PAGES)
    whole = {r.name: (r.n_pages, r.text) for r in chunking.assemble_pages(pages).collect()}
    text = "".join((t or "") + "\n" for _, _, t in rows)
    assert whole == {"long.pdf": (2499, text), "nulls.pdf": (3, "\n" + "z" * 60 + "\n\n")}
    got = {(r.source_name, r.chunk_id): r.chunk for r in chunking.chunk_pages(pages).collect()}
    assert got == {(n, i): c for n, (_, t) in whole.items() for i, c in enumerate(chunk_python(t))}


def test_accepted_names(spark):
    df = spark.createDataFrame([("a.pdf",), ("a.PDF",), ("",), (None,), ("x.pdf.txt",)], "name string")
    assert [r.reject_reason for r in chunking.accepted_names(df).collect()] == [None, "not_pdf", "no_name", "no_name", "not_pdf"]


def test_stream_equals_batch_and_replaces(spark, tmp_path):
    docs = [(f"s{i}", "word%d " % i * 200) for i in range(6)]
    for i, part in enumerate((docs[:3], docs[3:])):
        spark.createDataFrame(part, "source_name string, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("source_name string, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    arrivals.ingest_documents(stream, f"{tmp_path}/kb", f"{tmp_path}/cp", ENCODER).awaitTermination()
    got = arrivals.load_chunks(spark, f"{tmp_path}/kb")
    want = chunking.chunk_documents(spark.createDataFrame(docs, "source_name string, text string"))
    columns = ["source_name", "chunk_id", "chunk"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert got.select("version").distinct().count() == 2
    # A replayed batch and a newer upload both replace instead of adding.
    again = spark.createDataFrame([("s0", "new " * 60), ("short", "tiny")], "source_name string, text string")
    for _ in range(2):
        counts = {r.source_name: r.chunks for r in arrivals.add_documents(again, f"{tmp_path}/kb", ENCODER, 7).collect()}
    assert counts == {"s0": 1, "short": 0}
    # A second stream into the same folder starts at batch 0 and must not touch the first one's rows.
    spark.createDataFrame([("other", "more " * 60)], "source_name string, text string").write.parquet(f"{tmp_path}/in2")
    second = spark.readStream.schema("source_name string, text string").parquet(f"{tmp_path}/in2")
    arrivals.ingest_documents(second, f"{tmp_path}/kb", f"{tmp_path}/cp2", ENCODER).awaitTermination()
    assert arrivals.load_chunks(spark, f"{tmp_path}/kb").where("source_name = 'other'").count() == 1
    emptied = spark.createDataFrame([("other", "tiny"), ("other", "smaller")], "source_name string, text string")
    assert [(r.source_name, r.chunks) for r in arrivals.add_documents(emptied, f"{tmp_path}/kb", ENCODER, 8).collect()] == [("other", 0)]
    assert {r.name for r in registry.active(arrivals.load_registry(spark, f"{tmp_path}/kb/registry")).collect()} == {"other", "short", *(f"s{i}" for i in range(6))}
    now = arrivals.load_chunks(spark, f"{tmp_path}/kb")
    assert now.where("source_name = 's0'").count() == 1 and now.count() == got.where("source_name <> 's0'").count() + 1


def test_empty_knowledge(spark, tmp_path):
    chunks = arrivals.load_chunks(spark, f"{tmp_path}/none")
    queries = spark.createDataFrame([(1, "hello")], "query_id long, text string")
    hits = retrieve.knowledge_search(queries, chunks, ENCODER)
    assert hits.count() == 0
    assert context.knowledge_blocks(queries.select("query_id"), hits).first().knowledge == ""


def test_registry(spark, tmp_path):
    log = [
        ("a.pdf", 3, "2024-01-01 00:00:00", "p/a", "upsert", 1), ("a.pdf", 5, "2024-01-02 00:00:00", "p/a", "upsert", 2),
        ("b.pdf", None, "2024-01-01 00:00:00", None, "upsert", 3), ("c.pdf", 1, "2024-01-01 00:00:00", "p/c", "upsert", 4),
        ("c.pdf", 1, "2024-01-01 00:00:00", "p/c", "delete", 5),
    ]
    df = spark.createDataFrame(log, "name string, pages long, t string, path string, op string, seq long").select(
        "name", "pages", F.col("t").cast("timestamp_ntz").alias("added_at"), "path", "op", "seq"
    )
    arrivals.append_registry(df, f"{tmp_path}/log", 0)
    stored_log = arrivals.load_registry(spark, f"{tmp_path}/log")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("not a table")
    assert arrivals.load_registry(spark, f"{tmp_path}/bad", tolerant=True).count() == 0
    listed = {r.name: (r.pages, r.added_date, r.path) for r in registry.listing(stored_log).collect()}
    assert listed == {"a.pdf": (5, "2024-01-02 00:00:00", "p/a"), "b.pdf": (0, "2024-01-01 00:00:00", "")}
    assert registry.status(stored_log).first().n == 2
    ask = spark.createDataFrame([("a.pdf", 9), ("zz.pdf", 10)], "name string, seq long").withColumn(
        "requested_at", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    )
    outcome = registry.delete_rows(stored_log, ask)
    assert {r.name: r.found for r in outcome.collect()} == {"a.pdf": True, "zz.pdf": False}
    arrivals.append_registry(outcome.where("found").drop("found"), f"{tmp_path}/log", 1)
    after = arrivals.load_registry(spark, f"{tmp_path}/log")
    assert [r.name for r in registry.active(after).collect()] == ["b.pdf"]
    chunks = spark.createDataFrame([("a.pdf", 0), ("b.pdf", 0), ("new.pdf", 0)], "source_name string, chunk_id long")
    assert {r.source_name for r in registry.visible_chunks(chunks, after).collect()} == {"b.pdf", "new.pdf"}


def test_history(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x" * 90), (2, "short")], "seq long, text string").select(
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"), "seq", "text", F.lit("phishing").alias("label"),
        F.lit("critical").alias("risk_level"),
    )
    arrivals.append_history(rows, f"{tmp_path}/h", 0)
    got = registry.history(arrivals.load_history(spark, f"{tmp_path}/h")).collect()
    assert [r.preview for r in got] == ["short", "x" * 80 + "..."]
    with pytest.raises(ValueError):
        source.clear_history(spark, f"{tmp_path}/h")
    source.clear_history(spark, f"{tmp_path}/h", confirm=True)
    assert arrivals.load_history(spark, f"{tmp_path}/h").count() == 0


def corpus_rows():
    return [
        (i, f"Verify your account number {i} now", None, "phishing" if i % 2 else "legitimate", "en", None, "low", "sms")
        for i in range(30)
    ]


def test_stored_index_and_fingerprint(spark, tmp_path):
    docs = spark.createDataFrame(corpus_rows(), schema.CORPUS).select("doc_id", "text")
    index, vectors = stored.build_retrieval_system(docs, str(tmp_path), ENCODER)
    lazy = build_lexical_index(docs)
    for name in ("postings", "term_stats", "corpus_stats"):
        rows = [sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in getattr(ix, name).collect()) for ix in (index, lazy)]
        assert rows[0] == rows[1], name
    assert vectors.count() == 30
    before = sorted(p.name for p in tmp_path.iterdir())
    stored.build_retrieval_system(docs, str(tmp_path), ENCODER)
    assert sorted(p.name for p in tmp_path.iterdir()) == before
    stored.build_retrieval_system(docs.where("doc_id > 0"), str(tmp_path), ENCODER)
    assert len(list(tmp_path.iterdir())) == 2
    # Another encoder under the same path gets vectors of its own.
    _, wide = stored.build_retrieval_system(docs, str(tmp_path), HashingEncoder(32, "md5"))
    assert len(wide.first().embedding) == 32
    _, narrow = stored.build_retrieval_system(docs, str(tmp_path), ENCODER)
    assert len(narrow.first().embedding) == 16
    docs.write.parquet(f"{tmp_path}/src")
    marks = {stored.file_fingerprint(spark.read.parquet(f"{tmp_path}/src")) for _ in range(2)}
    docs.write.mode("append").parquet(f"{tmp_path}/src")
    assert len(marks) == 1 and stored.file_fingerprint(spark.read.parquet(f"{tmp_path}/src")) not in marks


def test_corpus_readers(spark, tmp_path):
    df = spark.createDataFrame(corpus_rows(), schema.CORPUS)
    source.write_table(source.with_norm_text(df).withColumn("norm_text", F.when(F.col("doc_id") > 4, F.col("norm_text"))), f"{tmp_path}/p")
    assert source.load_corpus(spark, f"{tmp_path}/p").count() == 25
    head = ",".join(schema.CORPUS.fieldNames())
    body = '1,"a, ""b""\nc",a b,phishing,en,none,low,sms\n2,t,,legitimate,fr,none,low,url\n'
    (tmp_path / "h0.csv").write_text(head + "\n" + body, encoding="utf-8")
    (tmp_path / "h1.csv").write_text("some title line,,,,,,,\n" + head + "\n" + body, encoding="utf-8")
    for name, row in (("h0.csv", 0), ("h1.csv", 1)):
        got = source.load_corpus(spark, f"{tmp_path}/{name}", "csv", header_row=row).collect()
        assert [(r.doc_id, r.text, r.label) for r in got] == [(1, 'a, "b"\nc', "phishing")]
    (tmp_path / "bad.csv").write_text("title,,,,,,,\n" + head + "\n" + body + "x7,t,n,phishing,en,none,low,sms\n", encoding="utf-8")
    with pytest.raises(Exception, match="x7"):
        source.load_corpus(spark, f"{tmp_path}/bad.csv", "csv", header_row=1).collect()
    source.write_csv(df.select("doc_id", "label"), f"{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").columns == ["doc_id", "label"]


def test_screening_end_to_end(spark):
    corpus = spark.createDataFrame(corpus_rows(), schema.CORPUS)
    docs = corpus.select("doc_id", "text")
    index, vectors = build_lexical_index(docs), ENCODER.encode(docs, "text", keep=["doc_id"])
    messages = spark.createDataFrame(
        [(1, " verify your account 7 "), (2, "http://a-b.xyz/verify"), (3, "hey"), (4, "   "), (5, "meeting at ten")],
        "query_id long, text string",
    )
    routed = {r.query_id: r for r in screen.route_messages(messages).collect()}
    assert (routed[1].channel, routed[2].channel, routed[3].error, routed[4].error) == ("message", "url", "too_short", "empty")
    assert routed[2].url_features.suspicious_tld and routed[2].search_text.startswith("URL analyzed: http://a-b.xyz/verify\n")
    queries = screen.route_messages(messages).where("search_text is not null").select("query_id", F.col("search_text").alias("text"))
    chunks = ENCODER.encode(
        spark.createDataFrame([("k.pdf", 0, "verify account guide")], "source_name string, chunk_id long, chunk string"), "chunk"
    )
    table, cases = screen.build_prompts(queries, corpus, index, vectors, ENCODER, chunks)
    prompts = {r.query_id: r.prompt for r in table.collect()}
    assert set(prompts) == {1, 2, 5} and "Example 5" in prompts[1] and "verify account guide" in prompts[1]
    assert "[[" not in prompts[1]

    def respond():
        return lambda texts: ['{"label":"phishing","confidence":0.9,"risk_score":80}' if "a-b.xyz" in t else "sorry" for t in texts]

    answers = screen.ask(table, "m1", respond)
    rows = {r.query_id: r for r in screen.screen_messages(messages, corpus, index, vectors, ENCODER, answers).collect()}
    assert (rows[2].label, rows[2].risk_level, rows[2].confidence_pct, rows[2].retrieved_examples) == ("phishing", "critical", 90, 5)
    assert len(rows[2].similar_cases) == 5 and rows[2].similar_cases[0].channel == "sms"
    assert rows[1].label == "error" and rows[1].similar_cases == [] and rows[3].label is None
    assert rows[1].prompt and rows[3].prompt is None

    def breaks():
        def answer(texts):
            if any("meeting at ten" in t for t in texts):
                raise TimeoutError("no answer")
            return ['{"label":"legitimate","confidence":"high","risk_score":5}' for _ in texts]

        return answer

    both = screen.screen_messages(
        messages, corpus, index, vectors, ENCODER, {"m1": respond, "m2": breaks}, chunks=chunks
    ).collect()
    told = {(r.query_id, r.model): r for r in both}
    assert (told[5, "m2"].label, told[5, "m2"].error_type) == ("error", "TimeoutError") and told[1, "m2"].label == "legitimate"
    assert told[2, "m1"].label == "phishing" and "verify account guide" in told[2, "m1"].knowledge and told[3, None].error == "too_short"
    assert {k: r.prompt for (k, m), r in told.items() if m == "m1"} == prompts


def test_samples(spark):
    df = spark.createDataFrame(corpus_rows(), schema.CORPUS)
    first = [r.doc_id for r in sampling.simple_sample(df, 10).collect()]
    assert len(first) == 10 and sorted(first) == sorted(r.doc_id for r in sampling.simple_sample(df.repartition(7), 10).collect())
    assert sampling.simple_sample(df, 99).count() == 30
    assert {r[0]: r[1] for r in sampling.stratified_sample(df, 4).groupBy("label").count().collect()} == {"phishing": 4, "legitimate": 4}
    assert {r.label for r in sampling.short_classes(df, 16).collect()} == {"phishing", "legitimate"}


def test_screening_stream_with_retrieval_equals_batch(spark, tmp_path):
    corpus = spark.createDataFrame(corpus_rows(), schema.CORPUS)
    docs = corpus.select("doc_id", "text")
    index, vectors = build_lexical_index(docs), ENCODER.encode(docs, "text", keep=["doc_id"])
    messages = [(i, f"please verify account {i}") for i in range(8)]
    for part in (messages[:4], messages[4:]):
        spark.createDataFrame(part, "query_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def analyse(batch):
        return retrieve.hybrid_search(batch, index, vectors, ENCODER)

    stream = spark.readStream.schema("query_id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    arrivals.screen_stream(stream, f"{tmp_path}/log", f"{tmp_path}/cp", analyse).awaitTermination()
    columns = ["query_id", "doc_id", "rank", "rrf_score"]
    got = spark.read.parquet(f"{tmp_path}/log").select(columns).collect()
    want = analyse(spark.createDataFrame(messages, "query_id long, text string")).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 40


def test_loading_chunks_shuffles_no_text(spark, tmp_path):
    """Old versions, deleted and chunkless documents go by a broadcast of their names; beyond the bound the rows are the same."""
    home, long = str(tmp_path / "kb"), "some words of a document " * 9
    put = lambda rows, version: arrivals.add_documents(spark.createDataFrame(rows, "source_name string, text string"), home, HashingEncoder(8), version)
    put([(f"d{i}", f"{i} {long}") for i in range(6)] + [(None, long)], 0)
    plain = arrivals.load_chunks(spark, home)
    assert "Exchange" not in plain._jdf.queryExecution().executedPlan().toString() and plain.count() == 6
    put([("d1", "gone"), ("d2", f"new {long}")], 1)
    requests = spark.createDataFrame([("d3", dt.datetime(2100, 1, 1), 1)], "name string, requested_at timestamp_ntz, seq long")
    arrivals.delete_documents(spark, home, requests, 2)
    some = arrivals.load_chunks(spark, home)
    shown = some._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in shown and "SortMergeJoin" not in shown
    live = arrivals._live_documents(spark, home)
    every = spark.read.parquet(f"{home}/chunks").withColumn("sink", F.col("sink").cast("string"))
    want = every.join(live, ["source_name", "sink", "version"], "left_semi")
    key = lambda df: sorted(map(tuple, df.select("source_name", "version", "chunk_id", "chunk").collect()))
    assert key(some) == key(want) and {r[0] for r in key(some)} == {"d0", "d2", "d4", "d5"}
