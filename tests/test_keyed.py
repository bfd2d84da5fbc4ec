"""Top-k with identity, the stored cell index and the stored knowledge base."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from msgscreen import scale
from msgscreen.operators import keyed
from msgscreen.sources import cells


def made(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim))
    v = centres[rng.integers(0, 9, n)] + 0.4 * rng.normal(size=(n, dim))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype("float32")


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies under other names: ties that only the key can order; a name that is null."""
    v = made(300, 12, 1)
    rng = random.Random(1)
    names = [f"n{rng.randrange(40):02d}" for _ in v]
    rows = [(name, i, [float(x) for x in vec], f"chunk {i}") for i, (name, vec) in enumerate(zip(names, v))]
    rows += [(f"copy{i % 7}", 1000 + i, rows[5][2], "copy") for i in range(150)] + [(None, 2000, rows[5][2], "nameless")]
    return spark.createDataFrame(rows, "name string, part long, embedding array<float>, chunk string").repartition(5).persist()


def wanted(queries, rows, k, allowed=lambda q, r: True):
    out = []
    for q, vec in queries:
        scored = [(-round(float(np.dot(np.array(vec, "float64"), np.array(r.embedding, "float64"))), 6), r.name is not None, r.name or "", r.part) for r in rows if allowed(q, r)]
        out += [(q, rank + 1, -s, name if known else None, part) for rank, (s, known, name, part) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize(("bound", "batch"), [(scale.BROADCAST_BYTES, "10000"), (400, "16")])
def test_keyed_topk(spark, corpus, monkeypatch, bound, batch):
    monkeypatch.setattr(keyed, "BROADCAST_BYTES", bound)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    asked = [(i, [float(x) for x in v]) for i, v in enumerate(made(20, 12, 2))] + [(50, corpus.where("part = 5").first().embedding)]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<float>")
    try:
        got = keyed.keyed_topk(queries, corpus, 4, ["name", "part"], ["chunk"]).orderBy("query_id", "rank").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [tuple(r)[:5] for r in got] == sorted(wanted(asked, corpus.collect(), 4), key=lambda r: r[:2])
    assert all(r.chunk in ("copy", "nameless") or r.chunk == f"chunk {r.part}" for r in got)
    assert keyed.keyed_topk(queries.limit(0), corpus, 4, ["name"]).collect() == []
    assert keyed.keyed_topk(queries, corpus.limit(0), 4, ["name"]).collect() == []


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells"))
    v = made(1200, 20, 3)
    rows = [(i, [float(x) for x in vec]) for i, vec in enumerate(v)] + [(5000, None), (5001, [1.0])]
    frame = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    cells.fit_cells(frame.where("size(embedding) = 20"), path, 24, slices=6, codes=32, fit_rows=700)
    for version in range(3):
        cells.add_vectors(frame.where(F.col("doc_id") % 3 == version), path, version)
    cells.add_vectors(frame.where("doc_id % 3 = 1"), path, 1)  # a replay replaces itself
    return path, frame.where("size(embedding) = 20")


def exact(spark, frame, queries, k):
    return {(r.query_id, r.doc_id) for r in keyed.keyed_topk(queries, frame.withColumn("name", F.lit("")), k + 1, ["doc_id"]).collect() if r.query_id != r.doc_id and r.rank <= k + 1}


def test_cells_hold_every_vector_once(spark, store):
    path, frame = store
    rows = cells.load_rows(spark, path)
    assert sorted(r.doc_id for r in rows.select("doc_id").collect()) == list(range(1200))
    assert rows.select("cell").distinct().count() > 12


def test_search_is_exact_over_all_cells(spark, store):
    path, frame = store
    queries = frame.where("doc_id % 40 = 0").withColumnRenamed("doc_id", "query_id")
    got = cells.cell_topk(queries, path, 5, ["doc_id"], probes=24, refine=40, exclude_self=True).collect()
    asked = [(r.query_id, r.embedding) for r in queries.collect()]
    rows = [type("R", (), {"name": "", "part": r.doc_id, "embedding": r.embedding}) for r in frame.collect()]
    want = wanted(asked, rows, 5, lambda q, r: q != r.part)
    assert sorted((r.query_id, r["rank"], r.score, r.doc_id) for r in got) == sorted((q, rank, s, part) for q, rank, s, _, part in want)


def test_search_reads_probed_folders_and_recalls(spark, store):
    path, frame = store
    queries = frame.where("doc_id % 40 = 0").withColumnRenamed("doc_id", "query_id")
    asked = [(r.query_id, r.embedding) for r in queries.collect()]
    rows = [type("R", (), {"name": "", "part": r.doc_id, "embedding": r.embedding}) for r in frame.collect()]
    want = {(q, part) for q, _, _, _, part in wanted(asked, rows, 5, lambda q, r: q != r.part)}
    found = cells.cell_topk(queries, path, 5, ["doc_id"], probes=6, exclude_self=True)
    recall = len({(r.query_id, r.doc_id) for r in found.collect()} & want) / len(want)
    assert recall >= 0.9
    one = cells.cell_topk(queries.limit(1), path, 5, ["doc_id"], probes=2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters: ")[1].split("]")[0]


def test_few_vectors(spark, tmp_path):
    frame = spark.createDataFrame([(1, [1.0, 0.0, 0.5]), (2, [0.0, 1.0, 0.5])], "doc_id long, embedding array<float>")
    cells.fit_cells(frame, str(tmp_path), 8, slices=2)
    cells.add_vectors(frame, str(tmp_path), 0)
    queries = spark.createDataFrame([(7, [1.0, 0.0, 0.0]), (8, None)], "query_id long, embedding array<float>")
    got = cells.cell_topk(queries, str(tmp_path), 5, ["doc_id"])
    assert sorted((r.query_id, r["rank"], r.score, r.doc_id) for r in got.collect()) == [(7, 1, 1.0, 1), (7, 2, 0.0, 2)]
    with pytest.raises(ValueError, match="no vectors"):
        cells.fit_cells(frame.limit(0), f"{tmp_path}/none", 4)
