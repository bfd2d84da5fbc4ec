"""Pruned searches against the plans that score everything."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from msgscreen.operators import ann, dense, lexical, pruned
from msgscreen.scale import measured


def rows(df):
    return sorted(map(tuple, df.select("query_id", "doc_id", "rank", "score").collect()))


@pytest.fixture(scope="module")
def texts(spark):
    """Topics of their own words over common ones, copies, empty and null texts, one very long text."""
    rng = random.Random(2)
    common = ["the", "of", "and", "a"]
    docs = []
    for i in range(1200):
        topic = [f"t{i // 60}w{j}" for j in range(25)]
        docs.append((i, " ".join(rng.choices(common, k=12) + rng.choices(topic, k=rng.randrange(1, 20)))))
    docs += [(2000 + i, docs[7][1]) for i in range(400)] + [(3000, ""), (3001, None), (3002, "the " * 5000 + "t3w1")]
    queries = [(q, " ".join(rng.choices(common, k=3) + rng.choices([f"t{rng.randrange(20)}w{j}" for j in range(25)], k=4))) for q in range(30)]
    queries += [(100, "the of"), (101, "nothing known"), (102, ""), (103, None), (104, docs[7][1]), (105, "t3w1 t3w1 the")]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "query_id long, text string")


@pytest.mark.parametrize(("block", "first", "k"), [(16, 4, 10), (128, 1, 3), (4, 2, 50)])
def test_bm25_rows_equal(spark, texts, tmp_path, block, first, k):
    docs, queries = texts
    index = lexical.build_lexical_index(docs)
    pruned.save_blocks(index, str(tmp_path), block)
    blocks = pruned.load_blocks(spark, str(tmp_path))
    got = rows(pruned.bm25_pruned(queries, blocks, k, first=first))
    assert got == rows(lexical.bm25_topk(queries, index, k, plan="scan"))


def test_block_maxima_are_taken_once(spark, texts, tmp_path, monkeypatch):
    """Finding the bounds of a range would read the documents, and take their maxima, a second time."""
    seen, peaks = spark.sparkContext.accumulator(0), pruned._peaks

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield from peaks([batch])

    monkeypatch.setattr(pruned, "_peaks", counted)
    index = lexical.build_lexical_index(texts[0])
    pruned.save_blocks(index, str(tmp_path), 16)
    assert seen.value == index.doc_terms.count() > 0


def test_bm25_blocks_are_skipped(spark, texts, tmp_path):
    docs, queries = texts
    index = lexical.build_lexical_index(docs.orderBy("doc_id"))
    pruned.save_blocks(index, str(tmp_path), 16)
    blocks = pruned.load_blocks(spark, str(tmp_path))
    terms = lexical.query_terms(queries.where("query_id < 30"))
    best, later, _ = pruned.asked_blocks(terms, blocks, 10, True)
    total = blocks.doc_terms.select("block").distinct().count()
    assert total >= 100
    assert best.count() + later.count() < 0.35 * 30 * total
    assert blocks.block_max.count() < index.postings.count()
    assert measured(blocks.block_max)[0] == blocks.doc_terms.select("block", F.explode("terms.term").alias("term")).distinct().count()
    one = later.where("block >= 0").limit(1)
    side = lexical.query_side(lexical.query_weights(terms, index, True), F.lit(1.0))
    shown = pruned._scored_blocks(one, side, blocks, 10, 1.5, 0.75)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shelf" in shown or "PartitionFilters: [shelf" in shown or "(shelf" in shown.split("PartitionFilters: ")[1][:80]
    assert "BroadcastHashJoin [shelf" in shown


def clustered(spark, n, dim, spread, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    v = centres[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, dim))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype("float32")
    made = [(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(n + i, [float(x) for x in v[0]]) for i in range(n // 3)]
    return spark.createDataFrame(made, "doc_id long, embedding array<float>")


@pytest.mark.parametrize("spread", [0.05, 5.0])
def test_dense_rows_equal(spark, tmp_path, spread):
    corpus = clustered(spark, 900, 16, spread)
    queries = corpus.where("doc_id % 9 = 0").withColumnRenamed("doc_id", "query_id")
    pruned.store_cells(ann.cells_of(corpus, corpus.where("doc_id < 40").withColumnRenamed("doc_id", "cell")), str(tmp_path))
    index = pruned.load_cells(spark, str(tmp_path))
    # Past the queries; to the cells, never, as decided by the yield of the bounds, and always.
    for plan, worthwhile in (("auto", 0.5), ("pairs", 0.0), ("pairs", 0.5), ("pairs", 1.0)):
        got = rows(pruned.dense_pruned(queries, index, 7, exclude_self=True, plan=plan, worthwhile=worthwhile))
        assert got == rows(dense.dense_topk(queries, corpus, 7, exclude_self=True))
    assert rows(pruned.dense_pruned(queries.limit(0), index, 7)) == []


def test_dense_cells_are_skipped(spark, tmp_path, monkeypatch):
    corpus = clustered(spark, 900, 16, 0.05)
    queries = corpus.where("doc_id % 9 = 0").withColumnRenamed("doc_id", "query_id")
    monkeypatch.setattr(ann, "CELL_ROWS", 100)
    pruned.save_cells(corpus, str(tmp_path), 40)
    index = pruned.load_cells(spark, str(tmp_path))
    assert index.vectors.count() == 1200 and index.cells.agg(F.max("n")).first()[0] <= 200  # crowded cells are split
    asked = []
    real = pruned.cell_demand
    monkeypatch.setattr(pruned, "cell_demand", lambda *a: asked.append(real(*a)) or asked[-1])
    monkeypatch.setattr(pruned, "dense_topk", None)  # no fallback
    for plan in ("scan", "pairs"):
        assert rows(pruned.dense_pruned(queries, index, 5, plan=plan)) == rows(dense.dense_topk(queries, corpus, 5))
    pairs = queries.count() * index.cells.count()
    assert all(sum(d.values()) + 3 * queries.count() < 0.4 * pairs for d in asked)


def test_few_vectors(spark, tmp_path):
    queries = spark.createDataFrame([(1, [0.5, 0.5])], "query_id long, embedding array<float>")
    want = [(1, 1, 1, 0.5), (1, 2, 2, 0.0)]
    for n in (2, 1, 0):
        corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])][:n], "doc_id long, embedding array<float>")
        pruned.save_cells(corpus, f"{tmp_path}/{n}")
        assert rows(pruned.dense_pruned(queries, pruned.load_cells(spark, f"{tmp_path}/{n}"), 5)) == want[:n]
