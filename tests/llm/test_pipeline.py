"""The pipeline on a small folder of tables, stage by stage, and the registered queries' schemas."""

import random

import pytest

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    home = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(11)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    benchmark = [(k, text(25)) for k in range(5)]
    docs, labels = [], []
    for i in range(300):
        t = text(60)
        if i % 6 == 0:
            t += " you idiot scum"
        docs.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, 1, int(i % 6 == 0)))
    base = text(100)
    docs += [(1000, base, "en", "s", len(base)), (1001, base, "en", "s", len(base)), (1002, base + " end", "en", "s", len(base) + 4)]
    leaked = text(30) + " " + benchmark[2][1] + " " + text(30)
    docs += [(1010, leaked, "en", "s", len(leaked)), (1020, text(40) + " password=Zx81kLm2qq " + text(20), "en", "s", 1)]
    docs += [(1030, None, None, None, None), (1031, "", None, None, 0), (None, text(20), "en", "s", 3)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id bigint, text string").write.parquet(f"{home}/benchmark.parquet")
    return home


def test_stages(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.schema, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).persist()
        assert [f.name for f in docs.schema] == [f.name for f in columns]
        seen.append({r.doc_id: r.text for r in docs.collect()})
    toxic, near, clean, masked = seen
    assert not any(i in toxic for i in range(0, 300, 6)) and sum(i in toxic for i in range(300)) == 250
    assert 1000 in near and 1001 not in near and 1002 not in near and None in near and {1030, 1031} <= near.keys()
    assert 1010 not in clean and len(clean) == len(near) - 1
    assert "[SECRET]" in masked[1020] and masked.keys() == clean.keys()
    assert masked[1] == clean[1] and masked[1030] is None


def test_run(spark, folder):
    import corpus_pipeline

    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {1000, 1020, 1030, 1031, None} <= {p.doc_id for p in pieces}
    assert not {1001, 1002, 1010, 0, 6} & {p.doc_id for p in pieces}


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
