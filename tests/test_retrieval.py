import math
import random

import pytest
from pyspark.sql import functions as F

from msgscreen.functions import vectors
from msgscreen.operators import ann, dense, fusion, lexical, retrieval_eval
from msgscreen.operators.embed import BatchEncoder, HashingEncoder
from msgscreen.plans import retrieve


@pytest.fixture(scope="module")
def tiny(spark):
    docs = spark.createDataFrame([(0, "a b a"), (1, "b c"), (2, "c d d e")], "doc_id long, text string")
    return lexical.build_lexical_index(docs)


def run_of(df):
    return [(r.query_id, r.doc_id, r.score) for r in df.orderBy("query_id", "rank").collect()]


@pytest.mark.parametrize("plan", ["scan", "join", "fragments"])
def test_bm25_golden(spark, tiny, plan):
    queries = spark.createDataFrame([(1, "A  b"), (2, "b b c"), (3, "z")], "query_id long, text string")
    got = run_of(lexical.bm25_topk(queries, tiny, 20, plan=plan))
    assert got == [
        (1, 0, 0.755292), (1, 1, 0.030049),
        (2, 1, 0.090146), (2, 0, 0.051083), (2, 2, 0.02221),
    ]
    padded = run_of(lexical.bm25_topk(queries, tiny, 3, plan=plan, pad=True))
    assert [(q, d) for q, d, _ in padded] == [(1, 0), (1, 1), (1, 2), (2, 1), (2, 0), (2, 2), (3, 0), (3, 1), (3, 2)]


def test_bm25_statistics(tiny):
    idf = {r.term: round(r.idf, 6) for r in tiny.term_stats.collect()}
    assert idf == {"a": 0.510826, "d": 0.510826, "e": 0.510826, "b": 0.025541, "c": 0.025541}
    stats = tiny.corpus_stats.first()
    assert (stats.n, stats.avgdl, round(stats.avg_idf, 6)) == (3, 3.0, 0.102165)


def brute_bm25(docs, queries, k):
    tokens = {i: t.lower().split() for i, t in docs}
    n, avg = len(docs), sum(map(len, tokens.values())) / len(docs)
    df = {}
    for words in tokens.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    out = []
    for q, text in queries:
        words = [w for w in text.lower().split() if w in idf]
        scored = []
        for i, doc in tokens.items():
            if set(words) & set(doc):
                s = sum(idf[w] * doc.count(w) * 2.5 / (doc.count(w) + 1.5 * (0.25 + 0.75 * len(doc) / avg)) for w in words)
                scored.append((-round(s, 6), i))
        out += [(q, i, -s) for s, i in sorted(scored)[:k]]
    return out


def test_bm25_plans_equal_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, "the " + " ".join(rng.choices(words, k=rng.randrange(0, 25)))) for i in range(300)]
    docs += [(300 + i, docs[0][1]) for i in range(150)]  # a third of all rows are copies
    queries = [(q, "the the " + " ".join(rng.choices(words, k=6))) for q in range(40)]
    index = lexical.build_lexical_index(spark.createDataFrame(docs, "doc_id long, text string"))
    asked = spark.createDataFrame(queries, "query_id long, text string")
    want = brute_bm25(docs, queries, 10)
    for options in ({"plan": "scan"}, {"plan": "join"}, {"plan": "fragments"}, {"plan": "fragments", "fragments": 6}):
        got = run_of(lexical.bm25_topk(asked, index, 10, **options))
        assert [(q, d) for q, d, _ in got] == [(q, d) for q, d, _ in want]
        assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want))


def random_vectors(spark, n, dim, name, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(n // 2)]  # copies
    df = spark.createDataFrame(rows, f"{name} long, embedding array<float>")
    return df.withColumn("embedding", vectors.l2_normalise(F.col("embedding")))


@pytest.mark.parametrize("exclude_self", [False, True])
def test_dense_plans_equal_expression(spark, exclude_self):
    corpus = random_vectors(spark, 200, 16, "doc_id", 1)
    queries = corpus.withColumnRenamed("doc_id", "query_id").where("query_id % 3 = 0")
    # Scores of all pairs by the pure expression, on a fixture of a few hundred rows.
    pairs = queries.withColumnRenamed("embedding", "q").crossJoin(corpus)
    if exclude_self:
        pairs = pairs.where("query_id <> doc_id")
    scored = pairs.select(
        "query_id", "doc_id", F.round(vectors.inner_product(F.col("q"), F.col("embedding")), 6).alias("score")
    ).collect()
    want = []
    for q in sorted({r.query_id for r in scored}):
        mine = sorted((r for r in scored if r.query_id == q), key=lambda r: (-r.score, r.doc_id))
        want += [(q, r.doc_id, r.score) for r in mine[:7]]
    for options in ({"plan": "broadcast"}, {"plan": "fragments", "fragments": 5}, {"plan": "fragments", "fragments": 1}):
        assert run_of(dense.dense_topk(queries, corpus, 7, exclude_self=exclude_self, **options)) == want


def test_dense_when_k_exceeds_rows(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "doc_id long, embedding array<float>")
    queries = corpus.withColumnRenamed("doc_id", "query_id")
    for plan in ("broadcast", "fragments"):
        assert len(run_of(dense.dense_topk(queries, corpus, 20, plan=plan, fragments=2))) == 4
    assert dense.dense_topk(queries, corpus.where("false"), 3, plan="broadcast").count() == 0


def test_ann_recall_and_full_probe(spark):
    corpus = random_vectors(spark, 300, 8, "doc_id", 2)
    queries = corpus.withColumnRenamed("doc_id", "query_id")
    index = ann.build_cells(corpus, cells=6)
    exact = dense.dense_topk(queries, corpus, 5)
    every = ann.ann_topk(queries, index, 5, probes=6)
    assert run_of(every) == run_of(exact)
    recall = ann.recall_against(ann.ann_topk(queries, index, 5, probes=2), exact).agg(F.avg("recall")).first()[0]
    assert 0.5 < recall <= 1.0


def test_crowded_cell_is_split(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 20)
    corpus = random_vectors(spark, 200, 8, "doc_id", 3)
    queries = corpus.withColumnRenamed("doc_id", "query_id")
    index = ann.build_cells(corpus, cells=3)
    assert run_of(ann.ann_topk(queries, index, 5, probes=3)) == run_of(dense.dense_topk(queries, corpus, 5))


def test_normalise_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>")
    got = [r[0] for r in df.select(vectors.l2_normalise(F.col("v"))).collect()]
    assert got[0] == [0.0, 0.0] and [round(x, 6) for x in got[1]] == [0.6, 0.8]


def test_rrf_golden(spark):
    runs = [
        spark.createDataFrame([(1, d, r) for r, d in enumerate(ids, 1)], "query_id long, doc_id long, rank int")
        for ids in ([3, 1, 2], [1, 4])
    ]
    got = [(r.doc_id, round(r.rrf_score, 6)) for r in fusion.rrf_fuse(runs).orderBy("rank").collect()]
    assert got == [(1, 0.032522), (3, 0.016393), (4, 0.016129), (2, 0.015873)]
    tie = [spark.createDataFrame([(1, d, 1)], "query_id long, doc_id long, rank int") for d in (9, 5)]
    assert [r.doc_id for r in fusion.rrf_fuse(tie).orderBy("rank").collect()] == [9, 5]


def test_metric_goldens(spark):
    relevance = {1: ([1, 0, 1, 1, 0], "a"), 2: ([0, 1], "b"), 3: ([], "c"), 4: ([0, 0], "d")}
    docs = [(i, "a") for i in range(10)] + [(20, "b"), (21, "b")] + [(30 + i, "c") for i in range(3)]
    run = []
    for q, (rel, label) in relevance.items():
        mine = [d for d, l in docs if l == label]
        others = [d for d, l in docs if l != label]
        for rank, r in enumerate(rel, 1):
            run.append((q, (mine if r else others)[rank - 1], rank))
    metrics = retrieval_eval.query_metrics(
        spark.createDataFrame(run, "query_id long, doc_id long, rank int"),
        spark.createDataFrame([(q, l) for q, (_, l) in relevance.items()], "query_id long, label string"),
        spark.createDataFrame(docs, "doc_id long, label string"),
        5,
    )
    got = {r.query_id: (r.precision, r.recall, r.hit, r.rr, round(r.ndcg, 6)) for r in metrics.collect()}
    assert got == {
        1: (0.6, 0.3, 1.0, 1.0, 0.654809), 2: (0.5, 0.5, 1.0, 0.5, 0.386853),
        3: (0.0, 0.0, 0.0, 0.0, 0.0), 4: (0.0, 0.0, 0.0, 0.0, 0.0),
    }


def test_unlabelled_model_has_null_metrics(spark):
    corpus = random_vectors(spark, 30, 4, "doc_id", 4).withColumn("label", F.lit(None).cast("string"))
    row = retrieve.retrieval_benchmark({"m": corpus}, sample_size=10).first()
    assert (row.n, row.dim, row.precision) == (45, 4, None)


def test_encoders(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "b a a")], "id long, text string")
    got = {r.id: r.embedding for r in HashingEncoder(8, "md5").encode(df, "text", keep=["id"]).collect()}
    assert got[1] == got[4] and got[2] == got[3] == [0.0] * 8
    assert round(sum(x * x for x in got[1]), 5) == 1.0

    def load():
        return lambda texts: [[float(len(t or "")), 1.0] for t in texts]

    rows = BatchEncoder(load, batch=2).encode(df, "text").orderBy("id").collect()
    assert [round(x, 6) for x in rows[1].embedding] == [0.0, 1.0] and rows[0].text == "a b a"


def test_fusion_bound(spark):
    docs = spark.createDataFrame([(i, f"w{i % 5} x{i % 3} y") for i in range(60)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "w1 y"), (2, "x2 w4")], "query_id long, text string")
    encoder = HashingEncoder(16)
    run = retrieve.hybrid_search(
        queries, lexical.build_lexical_index(docs), encoder.encode(docs, "text", keep=["doc_id"]), encoder
    ).collect()
    assert len(run) == 10 and all(0 < r.rrf_score <= 2 / 61 for r in run)


def test_benchmark_of_encoders(spark, tmp_path):
    from msgscreen.plans.benchmark import benchmark_encoders

    rows = [(i, f"{'pay now' if i % 2 else 'team lunch'} w{i % 7}", "phishing" if i % 2 else "legitimate") for i in range(60)]
    corpus = spark.createDataFrame(rows, "doc_id long, text string, label string")

    def broken():
        raise RuntimeError("no such model")

    encoders = {"small": HashingEncoder(16), "wide": HashingEncoder(64), "gone": BatchEncoder(broken)}
    got = {r.model: r for r in benchmark_encoders(corpus, encoders, sample_size=20, output_csv=f"{tmp_path}/b").collect()}
    assert set(got) == {"small", "wide", "gone"} and got["gone"].precision is None and got["gone"].error
    row = got["wide"]
    assert (row.n, row.dim, row.queries, row.index_size_mb) == (60, 64, 20, 0.01)
    assert row.precision > 0.9 and row.hit_rate == 1.0 and row.encoding_time_s > 0 and row.load_time_s > 0 and row.avg_search_time_ms > 0
    assert spark.read.option("header", True).csv(f"{tmp_path}/b").count() == 3


def test_plans_are_equal_around_their_bounds(spark, monkeypatch):
    """Batches of a broadcast, blocks of queries and merging in levels change plans, never rows."""
    from msgscreen import scale
    from msgscreen.operators import dense, lexical

    texts = [(i, f"w{i % 7} w{i % 5} w{i % 11} x{i}") for i in range(120)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    queries = spark.createDataFrame([(i, f"w{i % 7} w{i % 3} w{i % 11}") for i in range(30)], "query_id long, text string")
    index = lexical.build_lexical_index(docs)
    encoder = HashingEncoder(16)
    asked, vectors = encoder.encode(queries, "text", keep=["query_id"]), encoder.encode(docs, "text", keep=["doc_id"])
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(lexical.bm25_topk(queries, index, 4)), rows(dense.dense_topk(asked, vectors, 4))
    monkeypatch.setattr(scale, "FAN_IN", 2)
    monkeypatch.setattr(scale, "QUERY_BLOCK_BYTES", 1000)
    for bound in (100, 1 << 20):
        monkeypatch.setattr(lexical, "BROADCAST_BYTES", bound * 20)
        monkeypatch.setattr(dense, "BROADCAST_BYTES", bound)
        for plan in ("auto", "scan", "join", "fragments"):
            assert rows(lexical.bm25_topk(queries, index, 4, plan=plan, fragments=3)) == want[0], (bound, plan)
        for plan in ("auto", "broadcast", "fragments"):
            assert rows(dense.dense_topk(asked, vectors, 4, plan=plan, fragments=3)) == want[1], (bound, plan)


def test_a_task_meets_one_block_of_queries(spark):
    from msgscreen.scale import block_pairs

    q = spark.range(50).select(F.col("id").alias("query_id"))
    c = spark.range(90).select(F.col("id").alias("doc_id"))
    q, c = block_pairs(q, c, 4, 4)
    met = q.join(c, "frag")
    assert met.count() == 50 * 90 and met.select("query_id", "doc_id").distinct().count() == 50 * 90
    assert met.groupBy("frag").agg(F.countDistinct("query_id").alias("n")).agg(F.max("n")).first()[0] < 30


def test_fragments_send_only_asked_terms_and_copy_the_smaller_side(spark, monkeypatch):
    """Documents travel once, cut to the terms of the queries, though the queries come in four blocks."""
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} " + " ".join(f"x{i}y{j}" for j in range(50))) for i in range(200)] + [(900, "else"), (901, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, f"w{i} w{i + 1}") for i in range(4)], "query_id long, text string")
    index, sent, pairs = lexical.build_lexical_index(docs), [], lexical.block_pairs

    def caught(asked, corpus, fragments, blocks):
        both = pairs(asked, corpus, fragments, blocks)
        sent.append(both[1])
        return both

    monkeypatch.setattr(lexical, "block_pairs", caught)
    got = run_of(lexical.bm25_topk(queries, index, 10, plan="fragments", fragments=3, blocks=4))
    assert got == run_of(lexical.bm25_topk(queries, index, 10, plan="scan"))
    words = sent[0].select("doc_id", F.explode("terms.term").alias("term"))
    assert words.where("term NOT LIKE 'w%'").count() == 0
    assert sent[0].count() == sent[0].select("doc_id").distinct().count() < 202
    monkeypatch.setattr(lexical, "FRAGMENT_TOKENS", 1000)  # fragments stay bounded, whatever number was asked for
    lexical.bm25_topk(queries, index, 10, plan="fragments", fragments=3, blocks=1)
    assert sent[1].select("frag").distinct().count() > 3


def test_best_rows_without_selection_are_the_same(monkeypatch):
    """A bound from a sample or a floor replaces the selection of the k-th score, with ties and pairs that do not count."""
    import numpy as np

    from msgscreen.operators import blocks

    rng = np.random.default_rng(3)
    scores = np.round(rng.normal(size=(9, 9000)), 3)
    scores[1] = 0.5
    scores[2, rng.permutation(9000)[:8990]] = -np.inf
    ids = rng.permutation(9000)
    plain = [sorted(((-round(s, 6), i) for s, i in zip(line, ids) if np.isfinite(s)))[:7] for line in scores]
    calls, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda a, *rest, **named: calls.append(a.shape[1]) or partition(a, *rest, **named))
    for lines in ([0, 5, 6, 7, 8], range(9), [1], [2]):
        rows, docs, top = blocks.best_k(7)(ids, scores[list(lines)])
        got = [[(-t, d) for r, d, t in zip(rows, docs, top) if r == i] for i in range(len(list(lines)))]
        assert got == [plain[i] for i in lines]
        if list(lines) == [0, 5, 6, 7, 8]:
            assert max(calls) < 9000  # no selection over a whole line
    floor = np.array([-plain[i][-1][0] for i in (0, 5)])
    calls.clear()
    rows, docs, _ = blocks.best_k(7)(ids[:3000], scores[[0, 5], :3000], floor)
    assert not calls and set(docs) <= {i for at in (0, 5) for _, i in plain[at]}


def test_products_are_spread_over_tasks(spark, monkeypatch):
    vectors = random_vectors(spark, 200, 8, "doc_id", 4).coalesce(1)
    queries = vectors.withColumnRenamed("doc_id", "query_id")
    want = run_of(dense.dense_topk(queries, vectors, 5, plan="broadcast", exclude_self=True))
    monkeypatch.setattr(dense, "SCAN_PAIRS", 30_000)
    monkeypatch.setattr(dense, "BLOCK_PAIRS", 30_000)
    sent, score = [], dense.score_fragments
    monkeypatch.setattr(dense, "score_fragments", lambda q, c, k, n, x: sent.append(n) or score(q, c, k, n, x))
    run = dense._scan_with_broadcast(queries, vectors, 5, True)
    assert run.rdd.getNumPartitions() == 3
    assert run_of(dense.dense_topk(queries, vectors, 5, plan="broadcast", exclude_self=True)) == want
    assert run_of(dense.dense_topk(queries, vectors, 5, plan="fragments", exclude_self=True)) == want and sent == [3]


def test_joined_pairs_stay_in_their_task(spark):
    """Tasks of the join plan give k rows a query, not a row for each pair; documents that share an id add up."""
    docs = [(i, f"the w{i % 4}") for i in range(300)] + [(7, "the w3 w3"), (None, "the w1")]
    index = lexical.build_lexical_index(spark.createDataFrame(docs, "doc_id long, text string"))
    queries = spark.createDataFrame([(q, "the w1 w2") for q in range(20)] + [(3, "w2")], "query_id long, text string")
    terms = lexical.query_terms(queries)
    found = lexical._scored_by_join(terms, index, 4, 1.5, 0.75)
    assert found.count() <= 20 * 4 * found.rdd.getNumPartitions() < 20 * 301
    tf, mean = F.col("tf").cast("double"), lexical.average_length(index)
    part = F.col("w") * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * F.col("dl") / mean))
    pairs = index.postings.join(lexical.query_weights(terms, index, True), "term").groupBy("doc_id", "query_id").agg(F.round(F.sum(part), 6).alias("score"))
    want = lexical.merged_best(pairs.select("query_id", "doc_id", "score"), 4, 1)
    assert sorted(map(str, lexical.bm25_topk(queries, index, 4, plan="join").collect())) == sorted(map(str, want.collect()))
