"""Python tasks hold a block of a batch's texts, not a list of them all."""

import random
import tracemalloc

import pyarrow as pa

from msgscreen.llm import bottomk, toxicity
from msgscreen.llm.common import encoded, text_blocks


def _texts(n, size):
    rng = random.Random(5)
    words = [f"{a}{b}{c}{d}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst" for d in "aeiou"]
    return pa.array([" ".join(rng.choice(words) for _ in range(size)) for _ in range(n)])


def test_blocks_of_texts():
    values = pa.array(["one", None, "", "é" * 40, "two", "x" * 500, None])
    found = list(text_blocks(values, 64))
    assert [t for block in found for t in block] == encoded(values) and len(found) > 2
    assert [t for block in text_blocks(values.slice(2, 3), 64) for t in block] == encoded(values)[2:5]
    assert list(text_blocks(pa.array([], pa.string()))) == []
    assert [t for block in text_blocks(values.cast(pa.binary())) for t in block] == encoded(values)


def test_sketches_hold_no_whole_sets(spark):
    """40 MB of texts have sets of 64 MB; their sketches have 3."""
    values = _texts(6000, 1400)
    sketch = bottomk._sketcher(bottomk.WORDS, bottomk.K).func
    tracemalloc.start()
    try:
        n = sum(len(found) for found in sketch(iter([values])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == len(values) and peak < 40e6


def test_scores_of_blocks(spark):
    rows = [(i, t) for i, t in enumerate([None, "", *_texts(800, 100).to_pylist(), "idiot"])]
    docs = spark.createDataFrame(rows, "doc_id int, text string").coalesce(1)
    model = toxicity.ToxicityModel({"idiot": 5.0, "bala": 0.1}, -2.0)
    found = dict(toxicity.scored(docs, model).select("doc_id", "score").collect())
    assert [found[i] for i, _ in rows] == list(model.scores([t for _, t in rows]))
