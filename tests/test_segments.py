"""The index that follows a folder of files, against one built anew."""

import os
import random

import pytest
from pyspark.sql import functions as F

from msgscreen.operators import lexical
from msgscreen.scale import remove
from msgscreen.sources import segments

RNG = random.Random(3)
WORDS = [f"w{i}" for i in range(40)]


def made(ids, tag="the"):
    return [(i, f"{tag} " + " ".join(RNG.choices(WORDS, k=RNG.randrange(0, 20)))) for i in ids] + [(ids[0] + 500, None)]


def rows_of(index):
    stats = index.corpus_stats.first()
    return (
        sorted((r.doc_id, r.dl, sorted(map(tuple, r.terms))) for r in index.doc_terms.collect()),
        sorted(map(tuple, index.postings.select("term", "doc_id", "tf", "dl").collect())),
        sorted((r.term, r.df, round(r.idf, 9)) for r in index.term_stats.collect()),
        (stats.n, round(stats.avgdl, 9), round(stats.avg_idf, 9)),
    )


class Corpus:
    def __init__(self, spark, home):
        self.spark, self.home, self.store = spark, f"{home}/the corpus+%20é", f"{home}/store"
        self.held = {}

    def put(self, name, rows):
        self.held[name] = rows
        self.spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.mode("overwrite").parquet(f"{self.home}/batch={name}")

    def drop(self, name):
        del self.held[name]
        remove(self.spark, f"{self.home}/batch={name}")

    def scan(self):
        return self.spark.read.schema("doc_id bigint, text string, batch string").parquet(self.home)

    def refresh(self):
        return segments.refresh(self.scan(), self.home, self.store)

    def anew(self, without=()):
        rows = [r for held in self.held.values() for r in held if r[0] not in without]
        return rows_of(lexical.build_lexical_index(self.spark.createDataFrame(rows, "doc_id bigint, text string")))

    def now(self):
        return rows_of(segments.lexical_index(self.spark, self.store))


def test_follows_a_folder(spark, tmp_path):
    corpus = Corpus(spark, tmp_path)
    corpus.put("a", made(range(0, 30)))
    corpus.put("b", made(range(30, 60)))
    corpus.put("c", made(range(60, 90), "once"))
    assert corpus.refresh().number == 1
    assert corpus.now() == corpus.anew()
    assert corpus.refresh().number == 1  # nothing changed, nothing written

    corpus.put("d", made(range(90, 120)))
    corpus.put("b", made(range(30, 60), "changed"))
    corpus.drop("c")
    version = corpus.refresh()
    assert version.number == 2 and version.totals["files"] == 3
    assert corpus.now() == corpus.anew()
    assert "once" not in {r.term for r in version.term_stats.collect()}

    gone = [3, 4, 35, 500, 99_999]
    segments.remove_documents(spark, corpus.store, spark.createDataFrame([(i,) for i in gone], "doc_id bigint"))
    assert corpus.now() == corpus.anew(gone)
    corpus.put("b", made(range(30, 60), "again"))  # the file comes back whole, its removal is void
    corpus.refresh()
    assert corpus.now() == corpus.anew([3, 4, 500])

    before = corpus.now()
    assert segments.compact(spark, corpus.store).number == 5
    assert corpus.now() == before
    old = rows_of(segments.lexical_index(spark, corpus.store, 4))
    assert old == before
    segments.vacuum(spark, corpus.store)
    assert segments.versions(spark, corpus.store) == [5]
    assert sorted(os.listdir(f"{corpus.store}/doc_terms")) == ["segment=5"]
    assert corpus.now() == before
    corpus.put("e", made(range(200, 210)))
    corpus.refresh()
    assert corpus.now() == corpus.anew([3, 4, 500])


def test_reads_new_files_only(spark, tmp_path):
    corpus = Corpus(spark, tmp_path)
    for name in "abc":
        corpus.put(name, made(range(10 * ord(name), 10 * ord(name) + 5)))
    corpus.refresh()
    corpus.put("d", made(range(5000, 5005)))
    # Old files that cannot be read any more do not disturb a refresh: they are not opened.
    for folder, _, names in os.walk(corpus.home):
        for name in names:
            if name.endswith(".parquet") and "batch=d" not in folder:
                path = os.path.join(folder, name)
                stat = os.stat(path)
                with open(path, "r+b") as f:
                    f.write(b"\0" * stat.st_size)
                os.utime(path, ns=(stat.st_atime_ns, stat.st_mtime_ns))
                crc = os.path.join(folder, f".{name}.crc")
                if os.path.exists(crc):
                    os.remove(crc)
    corpus.refresh()
    assert corpus.now() == corpus.anew()
    version = segments.load_version(spark, corpus.store)
    dead = [version.files.where("path LIKE '%batch=a%'").first().file]
    plan = segments.live_doc_terms(spark, corpus.store, version, dead)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [file" in plan or "PartitionFilters: [isnotnull(file" in plan


def test_store_without_postings(spark, tmp_path):
    corpus = Corpus(spark, tmp_path)
    corpus.put("a", made(range(0, 9)))
    segments.refresh(corpus.scan(), corpus.home, corpus.store, postings=False)
    corpus.put("b", made(range(10, 19)))
    corpus.refresh()
    segments.compact(spark, corpus.store)
    assert not os.path.exists(f"{corpus.store}/postings")
    assert corpus.now() == corpus.anew()


def test_broken_refresh_leaves_the_version_before(spark, tmp_path, monkeypatch):
    corpus = Corpus(spark, tmp_path)
    corpus.put("a", made(range(0, 9)))
    corpus.refresh()
    before = corpus.now()
    corpus.put("b", made(range(10, 19)))
    monkeypatch.setattr(segments, "idf_of", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        corpus.refresh()
    monkeypatch.undo()
    assert corpus.now() == before
    corpus.refresh()
    assert corpus.now() == corpus.anew()


def test_empty_corpus_and_emptied_corpus(spark, tmp_path):
    corpus = Corpus(spark, tmp_path)
    with pytest.raises(ValueError, match="no complete version"):
        segments.lexical_index(spark, corpus.store)
    corpus.put("a", made(range(0, 9)))
    corpus.refresh()
    spark.createDataFrame([], "doc_id bigint, text string").write.mode("overwrite").parquet(f"{corpus.home}/batch=a")
    corpus.refresh()
    index = segments.lexical_index(spark, corpus.store)
    assert index.doc_terms.count() == index.term_stats.count() == 0
    queries = spark.createDataFrame([(1, "the w1")], "query_id bigint, text string")
    assert lexical.bm25_topk(queries, index, 5, plan="scan").collect() == []
    assert index.corpus_stats.where(F.col("n") == 0).count() == 1


def test_changes_shuffle_the_vocabulary_once_and_no_documents(spark, tmp_path, monkeypatch):
    corpus = Corpus(spark, tmp_path)
    corpus.put("a", made(range(0, 30)))
    corpus.put("b", made(range(30, 60)))
    plans, keep = {}, segments.stored

    def caught(df, purpose):
        plans[purpose] = df._jdf.queryExecution().executedPlan().toString()
        return keep(df, purpose)

    monkeypatch.setattr(segments, "stored", caught)
    corpus.refresh()
    corpus.put("c", made(range(60, 90)))
    corpus.drop("a")
    corpus.refresh()
    assert plans["counts"].count("Exchange hashpartitioning(term") == 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the ids were many
    try:
        segments.remove_documents(spark, corpus.store, spark.createDataFrame([(35,), (70,)], "doc_id bigint"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plans["removed"] and "BroadcastHashJoin [doc_id" in plans["removed"]
    assert corpus.now() == corpus.anew({35, 70})
