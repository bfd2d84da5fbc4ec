"""A lexical index that follows a folder of files: only new and changed files are read again.

Layout of a store:

* ``doc_terms/segment=<n>/file=<key>``, ``posting_blocks/segment=<n>``: term counts of the files that one refresh found new,
  written once and never changed. The key of a file is a digest of its path, size and time of change, so a
  changed file is a new file and its old rows are dead.
* ``versions/<n>``: a snapshot of what is live: ``files``, ``removed`` (documents removed by id), ``term_stats`` and
  ``corpus_stats``. ``files`` is written last; a version without its success mark does not exist, so a job that
  breaks off leaves the version before. One writer at a time.

Statistics are those of the version before, plus the counts of new files, minus the counts of dead files and removed
documents, each read from their own stored folders. The result equals an index built anew from the live documents;
ids must be unique over the live files. A refresh costs the new and dead files and the vocabulary, whatever the size
of the corpus; ``compact`` writes the live rows of many segments as one. Names of new and dead files come to the
driver, which lists the files of each scan anyway.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from msgscreen import schema
from msgscreen.operators.lexical import LexicalIndex, build_doc_terms, idf_of, postings_in, postings_of
from msgscreen.scale import broadcast_bounded, child_names, path_exists, remove, stored
from msgscreen.sources.index import save_posting_blocks

FILES = T.StructType([T.StructField("file", T.StringType()), T.StructField("path", T.StringType()), T.StructField("segment", T.LongType())])
REMOVED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("file", T.StringType())])
TOTALS = T.StructType([*schema.CORPUS_STATS.fields, *[T.StructField(c, T.LongType()) for c in ("tokens", "files", "removed")]])
PLACE = [T.StructField("segment", T.LongType()), T.StructField("file", T.StringType())]
#: Bytes of a row of ``files`` or ``removed`` in a broadcast.
ROW_BYTES = 96


@dataclass(frozen=True)
class Version:
    """What is live at one version; ``totals`` is its single row of counts."""

    number: int
    files: DataFrame
    removed: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame
    totals: dict


def _key(path: Column, size: Column, changed: Column) -> Column:
    plain = F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
    return F.md5(F.concat_ws("|", plain, size.cast("string"), F.unix_millis(changed).cast("string")))


def file_of_row() -> Column:
    """Key of the file that a row of a plain file scan comes from; filters on it drop whole files."""
    return _key(*[F.col(f"_metadata.{c}") for c in ("file_path", "file_size", "file_modification_time")])


def files_in(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, path)`` of the files below a folder: a listing, whose rows are files; nothing is opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    encoded = F.replace(F.replace("path", F.lit("%"), F.lit("%25")), F.lit("+"), F.lit("%2B"))
    return listed.select(_key(encoded, F.col("length"), F.col("modificationTime")).alias("file"), "path")


def versions(spark: SparkSession, store: str) -> list[int]:
    """Complete versions, oldest first."""
    found = sorted(int(n) for n in child_names(spark, f"{store}/versions") if n.isdigit())
    return [n for n in found if path_exists(spark, f"{store}/versions/{n}/files/_SUCCESS")]


def load_version(spark: SparkSession, store: str, number: int | None = None) -> Version | None:
    """The newest complete version, or the one asked for; None in an empty store."""
    known = versions(spark, store)
    if not known:
        return None
    number = known[-1] if number is None else number

    def table(name: str, kind: T.StructType) -> DataFrame:
        return spark.read.schema(kind).parquet(f"{store}/versions/{number}/{name}")

    totals = table("corpus_stats", TOTALS)
    return Version(
        number, table("files", FILES), table("removed", REMOVED), table("term_stats", schema.TERM_STATS),
        totals.select(*schema.CORPUS_STATS.fieldNames()), totals.first().asDict(),
    )


def _live(
    spark: SparkSession, store: str, name: str, kind: T.StructType, version: Version, files: list[str] | None = None
) -> DataFrame:
    """Rows of a stored table that are live in ``version``; ``files`` reads the folders of these files only."""
    rows = spark.read.schema(T.StructType([*kind.fields, *PLACE])).parquet(f"{store}/{name}")
    if files is not None:
        rows = rows.where(F.col("file").isin(files))
    listed = broadcast_bounded(version.files.select("segment", "file"), version.totals["files"], ROW_BYTES)
    rows = rows.join(listed, ["segment", "file"], "left_semi")
    if name == "posting_blocks":
        rows = postings_in(rows, "file")
    if version.totals["removed"]:
        removed = broadcast_bounded(version.removed, version.totals["removed"], ROW_BYTES)
        rows = rows.join(removed, ["doc_id", "file"], "left_anti")
    return rows


def live_doc_terms(spark: SparkSession, store: str, version: Version, files: list[str] | None = None) -> DataFrame:
    return _live(spark, store, "doc_terms", schema.DOC_TERMS, version, files)


def _write_segment(doc_terms: DataFrame, store: str, segment: int, with_postings: bool) -> DataFrame:
    """Store ``(doc_id, dl, terms, file)`` as one segment; returns the stored rows."""
    spark = doc_terms.sparkSession
    path = f"{store}/doc_terms/segment={segment}"
    doc_terms.select("doc_id", "dl", "terms", "file").write.mode("overwrite").partitionBy("file").parquet(path)
    rows = spark.read.schema(T.StructType([*schema.DOC_TERMS.fields, PLACE[1]])).parquet(path)
    if not with_postings:
        return rows
    save_posting_blocks(rows, f"{store}/posting_blocks/segment={segment}", ("file",))
    return rows


def _sizes(doc_terms: DataFrame) -> tuple[int, int]:
    row = doc_terms.agg(F.count("*"), F.sum(F.col("dl").cast("bigint"))).first()
    return int(row[0]), int(row[1] or 0)


def _write_version(
    store: str, number: int, files: DataFrame, removed: DataFrame, counts: DataFrame, n: int, tokens: int
) -> Version:
    spark, home = files.sparkSession, f"{store}/versions/{number}"
    removed.write.mode("overwrite").parquet(f"{home}/removed")
    term_stats, mean = idf_of(stored(counts, "counts"), F.lit(n))  # read three times below
    term_stats.write.mode("overwrite").parquet(f"{home}/term_stats")
    average = F.lit(tokens / n if n else None).cast("double")
    number_of = {"files": files.count(), "removed": spark.read.schema(REMOVED).parquet(f"{home}/removed").count(), "tokens": tokens}
    totals = mean.select(F.lit(n).cast("bigint").alias("n"), average.alias("avgdl"), "avg_idf", *[F.lit(v).cast("bigint").alias(k) for k, v in number_of.items()])
    totals.write.mode("overwrite").parquet(f"{home}/corpus_stats")
    files.write.mode("overwrite").parquet(f"{home}/files")
    return load_version(spark, store, number)


def _changed_counts(before: Version | None, plus: list[DataFrame], minus: list[DataFrame]) -> DataFrame:
    """Document frequencies after documents came and went; each side is a frame of ``doc_terms``."""
    sides = [(rows, 1) for rows in plus] + [(rows, -1) for rows in minus]
    parts = [rows.select(F.explode("terms.term").alias("term"), F.lit(sign).cast("bigint").alias("df")) for rows, sign in sides]
    if before is not None:
        parts.append(before.term_stats.select("term", "df"))
    merged = reduce(DataFrame.unionByName, parts)  # the vocabulary is shuffled once, whatever came and went
    return merged.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")


def refresh(corpus: DataFrame, folder: str, store: str, text: str = "text", postings: bool = True) -> Version:
    """Bring the store up to date with the files below ``folder``.

    ``corpus(doc_id, text)`` is a plain scan of the folder (``spark.read``), made after the files changed. A store made
    without ``postings`` keeps none: searches by scan or by blocks do not need the copy that is ranged by term.
    """
    spark = corpus.sparkSession
    postings = postings if not versions(spark, store) else path_exists(spark, f"{store}/posting_blocks")
    before = load_version(spark, store)
    now = files_in(spark, folder)
    if before is None:
        new, dead, number, n, tokens = now, [], 1, 0, 0
        known = removed = None
    else:
        known = before.files
        new = now.join(known.select("file"), "file", "left_anti")
        dead = [r["file"] for r in known.join(now.select("file"), "file", "left_anti").select("file").collect()]
        number, n, tokens = before.number + 1, before.totals["n"], before.totals["tokens"]
    fresh = [r["file"] for r in new.select("file").collect()]
    if before is not None and not fresh and not dead:
        return before
    plus, minus = [], []
    if dead:
        gone = live_doc_terms(spark, store, before, dead)
        minus.append(gone)
        rows, length = _sizes(gone)
        n, tokens = n - rows, tokens - length
    if fresh or before is None:
        read = corpus.select("doc_id", F.col(text).alias("text"), file_of_row().alias("file"))
        read = read if before is None else read.where(F.col("file").isin(fresh))
        segment = _write_segment(build_doc_terms(read, keep=["file"]), store, number, postings)
        plus.append(segment)
        rows, length = _sizes(segment)
        n, tokens = n + rows, tokens + length
    files = new.select("file", "path", F.lit(number).cast("bigint").alias("segment"))
    if before is None:
        removed = spark.createDataFrame([], REMOVED)
    else:
        still = ~F.col("file").isin(dead) if dead else F.lit(True)
        files, removed = files.unionByName(known.where(still)), before.removed.where(still)
    return _write_version(store, number, files, removed, _changed_counts(before, plus, minus), n, tokens)


def remove_documents(spark: SparkSession, store: str, ids: DataFrame) -> Version:
    """Take documents ``(doc_id)`` out of the index, wherever they are stored; unknown ids do nothing."""
    before = load_version(spark, store)
    wanted = stored(ids.select("doc_id").distinct(), "removed-ids")
    wanted = broadcast_bounded(wanted, wanted.count(), 32)  # the documents stay where they are
    gone = stored(live_doc_terms(spark, store, before).join(wanted, "doc_id", "left_semi"), "removed")
    rows, length = _sizes(gone)
    if not rows:
        return before
    removed = before.removed.unionByName(gone.select("doc_id", "file"))
    counts = _changed_counts(before, [], [gone])
    return _write_version(store, before.number + 1, before.files, removed, counts, before.totals["n"] - rows, before.totals["tokens"] - length)


def compact(spark: SparkSession, store: str) -> Version:
    """All live rows as one segment; texts are not read."""
    before = load_version(spark, store)
    number = before.number + 1
    _write_segment(live_doc_terms(spark, store, before), store, number, path_exists(spark, f"{store}/posting_blocks"))
    files = before.files.withColumn("segment", F.lit(number).cast("bigint"))
    counts = before.term_stats.select("term", "df")
    return _write_version(store, number, files, before.removed.limit(0), counts, before.totals["n"], before.totals["tokens"])


def vacuum(spark: SparkSession, store: str, keep: int = 1) -> None:
    """Delete all but the newest ``keep`` versions, and the segments that those do not use."""
    known = versions(spark, store)
    used = {str(r["segment"]) for n in known[-keep:] for r in load_version(spark, store, n).files.select("segment").distinct().collect()}
    for n in known[:-keep]:
        remove(spark, f"{store}/versions/{n}")
    for name in ("doc_terms", "posting_blocks", "postings"):
        for child in child_names(spark, f"{store}/{name}"):
            if child.startswith("segment=") and child.removeprefix("segment=") not in used:
                remove(spark, f"{store}/{name}/{child}")


def lexical_index(spark: SparkSession, store: str, number: int | None = None) -> LexicalIndex:
    """The index of the newest version, or of an older one that is still stored."""
    version = load_version(spark, store, number)
    if version is None:
        raise ValueError(f"no complete version in {store}")
    doc_terms = live_doc_terms(spark, store, version).select(*schema.DOC_TERMS.fieldNames())
    ranged = path_exists(spark, f"{store}/posting_blocks")
    postings = _live(spark, store, "posting_blocks", schema.POSTING_BLOCKS, version).select(*schema.POSTINGS.fieldNames()) if ranged else postings_of(doc_terms)
    return LexicalIndex(doc_terms, postings, version.term_stats, version.corpus_stats, stored=ranged)
