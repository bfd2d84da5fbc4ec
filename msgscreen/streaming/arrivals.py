"""Arriving documents and messages as micro-batches.

Every sink is idempotent: a batch writes its own ``sink=<name>/version=<batch id>`` folder in
overwrite mode, so a batch replayed after a lost driver replaces itself, and two streams (each
under a name of its own) never overwrite each other.

A knowledge base is a folder of three tables: ``chunks``, ``documents`` (a row per document and
version, written last, also when no chunk survived) and ``registry`` (the operation log).
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from msgscreen import schema
from msgscreen.operators import registry
from msgscreen.operators.chunking import chunk_documents, chunk_pages
from msgscreen.operators.embed import Encoder
from msgscreen.plans.screen import route_messages
from msgscreen.scale import BROADCAST_BYTES, broadcast_bounded, child_names, measured, stored, top_rows
from msgscreen.sources import cells
from msgscreen.sources.corpus import read_or_empty


def _start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _write_version(df: DataFrame, path: str, version: int, sink: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/sink={sink}/version={version}")


def _sink_name(checkpoint: str) -> str:
    """A stream is known by its checkpoint: the same one goes on, another one is another stream."""
    return hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def ingest_documents(
    docs: DataFrame, path: str, checkpoint: str, encoder: Encoder, *, sink: str | None = None, once: bool = True
) -> StreamingQuery:
    """Chunk, encode and append a stream of ``(source_name, text)`` to the knowledge base at ``path``."""
    name = sink or _sink_name(checkpoint)

    def add(batch: DataFrame, version: int) -> None:
        add_documents(batch, path, encoder, version, sink=name)

    return _start(docs, add, checkpoint, once)


def add_documents(
    docs: DataFrame,
    path: str,
    encoder: Encoder,
    version: int,
    *,
    sink: str = "batch",
    added_at: dt.datetime | None = None,
    order: list[Column] | None = None,
) -> DataFrame:
    """Add one batch of documents: chunks, document rows, registry rows. Returns ``(source_name, chunks, pages)``.

    A name given twice in the batch counts once: the row that comes first in ``order`` (by default the
    greatest text) is taken. Documents too short for a chunk count 0 and replace what they had before.
    Work grows with the batch, not with the table. ``added_at`` (now) orders versions over all sinks.
    Where the knowledge base has cells (``fit_chunk_cells``), the batch's vectors are filed under theirs here, once.
    """
    unique = top_rows(docs, ["source_name"], order or [F.desc("text")], 1).drop("rank")
    return _add_chunks(chunk_documents(unique), docs.select("source_name").distinct(), path, encoder, version, sink, added_at)


def _add_chunks(
    chunks: DataFrame, names: DataFrame, path: str, encoder: Encoder, version: int, sink: str, added_at: dt.datetime | None
) -> DataFrame:
    """Store the chunks of the documents ``names``, a row for each document, and their registry rows."""
    spark = chunks.sparkSession
    at = F.lit(added_at or dt.datetime.now(dt.UTC).replace(tzinfo=None)).cast("timestamp_ntz")
    encoded = encoder.encode(chunks, "chunk", keep=["source_name", "chunk_id", "chunk"])
    _write_version(encoded, f"{path}/chunks", version, sink)
    here = f"sink={sink}/version={version}"
    written = spark.read.schema(schema.KB_CHUNKS).parquet(f"{path}/chunks/{here}")
    if cells.has_model(spark, f"{path}/cells"):
        cells.add_vectors(written.select("source_name", "chunk_id", "embedding"), f"{path}/cells", version, sink)
    counted = written.groupBy("source_name").agg(F.count("*").alias("chunks"))
    rows = names.join(counted, "source_name", "left").select(
        "source_name", F.coalesce("chunks", F.lit(0)).cast("bigint").alias("chunks"), at.alias("added_at")
    )
    log = registry.upsert_rows(rows.select(
        F.col("source_name").alias("name"), F.col("chunks").alias("pages"), "added_at",
        F.col("source_name").alias("path"), F.lit(version).cast("bigint").alias("seq"),
    ))
    _write_version(log, f"{path}/registry", version, sink)
    _write_version(rows, f"{path}/documents", version, sink)
    done = spark.read.schema(schema.KB_DOCUMENTS).parquet(f"{path}/documents/{here}")
    return done.select("source_name", "chunks", F.col("chunks").alias("pages"))


#: Groups that documents are dealt out to while their pages are counted. A checkpoint keeps the number it began with.
COUNT_GROUPS = 1 << 10


def complete_documents(pages: DataFrame, groups: int = COUNT_GROUPS) -> DataFrame:
    """``(source_name, n_pages)`` of each document once all its pages have come, in whatever order and batches.

    ``pages(name, page_no, n_pages)`` is a stream; ``n_pages`` is the number of pages the document has. The state of a
    document is which pages were seen, a bit each, never their text; pages that come twice count once, and a document
    is reported once. Documents share one of ``groups`` states, since a call of Python for each document would cost
    more than its pages.
    """

    def track(key, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        seen = {n: None if done else bytearray(s) for n, s, done in zip(*state.get)} if state.exists else {}
        told: dict[str, int] = {}
        for frame in frames:
            for name, page, n in zip(frame["name"], frame["page_no"], frame["n_pages"]):
                bits = seen.setdefault(name, bytearray())
                told[name] = max(told.get(name, 0), int(n))
                if bits is None:  # reported
                    continue
                page = int(page)
                if page >> 3 >= len(bits):
                    bits.extend(bytes((page >> 3) + 1 - len(bits)))
                bits[page >> 3] |= 1 << (page & 7)
        ready = {n: total for n, total in told.items() if seen[n] is not None and int.from_bytes(seen[n]).bit_count() >= total}
        seen |= dict.fromkeys(ready)
        state.update((list(seen), [bytes(s or b"") for s in seen.values()], [s is None for s in seen.values()]))
        if ready:
            yield pd.DataFrame({"source_name": list(ready), "n_pages": list(ready.values())})

    told = pages.select("name", "page_no", "n_pages").where("name IS NOT NULL AND page_no >= 0")
    return told.withColumn("group", F.pmod(F.xxhash64("name"), F.lit(groups))).groupBy("group").applyInPandasWithState(
        track, "source_name string, n_pages bigint", "names array<string>, seen array<binary>, done array<boolean>", "append", GroupStateTimeout.NoTimeout
    )


def ingest_pages(
    pages: DataFrame, stored_pages: Callable[[], DataFrame], path: str, checkpoint: str, encoder: Encoder, *, sink: str | None = None, once: bool = True
) -> StreamingQuery:
    """Add documents whose pages arrive one by one: a document is chunked in the batch that brings its last page.

    ``pages(name, page_no, text, n_pages)`` streams the table that ``stored_pages()`` reads, so that texts wait there and
    not in the stream's state. Of a page that is stored twice the greater text counts.
    """
    name = sink or _sink_name(checkpoint)

    def add(batch: DataFrame, version: int) -> None:
        ready = stored(batch.select("source_name"), "ready")
        wanted = stored_pages().join(broadcast_bounded(ready.withColumnRenamed("source_name", "name"), ready.count(), 256), "name", "left_semi")
        single = wanted.groupBy("name", "page_no").agg(F.max("text").alias("text"))
        _add_chunks(chunk_pages(single), ready, path, encoder, version, name, None)

    return _start(complete_documents(pages), add, checkpoint, once)


def delete_documents(
    spark: SparkSession, path: str, requests: DataFrame, version: int, *, sink: str = "deletes"
) -> DataFrame:
    """Delete documents by ``(name, requested_at, seq)``; returns ``(name, found)``."""
    outcome = registry.delete_rows(load_registry(spark, f"{path}/registry"), requests)
    _write_version(outcome, f"{path}/delete_requests", version, sink)
    done = spark.read.schema(outcome.schema).parquet(f"{path}/delete_requests/sink={sink}/version={version}")
    _write_version(done.where("found").drop("found"), f"{path}/registry", version, sink)
    return done.select("name", "found")


def load_chunks(spark: SparkSession, path: str, deleted: bool = False) -> DataFrame:
    """Chunks of the newest version of each document that is not deleted; empty when nothing was stored.

    The newest version comes from the document rows (one per document and version), so a document
    re-added without a chunk has none. Chunks of old versions and deleted documents are dropped by a broadcast of
    those documents where it fits, else by a join that AQE may split.
    """
    return _of_live(read_or_empty(spark, f"{path}/chunks", schema.KB_CHUNKS), _live_documents(spark, path, deleted))


_VERSION = ["source_name", "sink", "version"]


def _live_documents(spark: SparkSession, path: str, deleted: bool = False) -> DataFrame:
    """``(source_name, sink, version)``: the newest version of each document that is not deleted."""
    known = read_or_empty(spark, f"{path}/documents", schema.KB_DOCUMENTS)
    order = [F.desc("added_at"), F.desc("version"), F.desc("sink")]
    newest = top_rows(known, ["source_name"], order, 1).select(*_VERSION)
    return newest if deleted else registry.visible_chunks(newest, load_registry(spark, f"{path}/registry"))


def _of_live(rows: DataFrame, live: DataFrame) -> DataFrame:
    """``rows`` of the documents in ``live``, unshuffled where the other documents, few as a rule, can be broadcast.

    Only names meet for that; texts and vectors do not.
    """
    dead = stored(rows.where("source_name IS NOT NULL").select(*_VERSION).distinct().join(live, _VERSION, "left_anti"), "dead")
    count, size = measured(dead)
    if size > BROADCAST_BYTES:
        return rows.join(live, _VERSION, "left_semi")
    kept = rows.where("source_name IS NOT NULL").select(*_VERSION, *[c for c in rows.columns if c not in _VERSION])
    return kept.join(F.broadcast(dead), _VERSION, "left_anti") if count else kept


def fit_chunk_cells(spark: SparkSession, path: str, count: int) -> None:
    """Fit cells on the chunks that are there and file them; later batches are filed as they are added."""
    every = read_or_empty(spark, f"{path}/chunks", schema.KB_CHUNKS)
    cells.fit_cells(every, f"{path}/cells", count)
    for row in every.select("sink", "version").distinct().collect():  # a row a batch
        batch = every.where((F.col("sink") == row["sink"]) & (F.col("version") == row["version"]))
        cells.add_vectors(batch.select("source_name", "chunk_id", "embedding"), f"{path}/cells", row["version"], row["sink"])


def chunk_hits(
    queries: DataFrame, path: str, k: int, *, probes: int = cells.PROBES, refine: int = cells.REFINE
) -> DataFrame:
    """``(query_id, rank, score, source_name, chunk_id, chunk)`` out of the cells nearest to ``queries(query_id, embedding)``.

    An approximate twin of ``knowledge_search``: reads the probed folders of the cells and the texts of the winners.
    """
    spark = queries.sparkSession
    kind = cells.load_rows(spark, f"{path}/cells")
    texts = load_chunks(spark, path)
    shown = texts.select(*_VERSION).distinct()
    live = kind.withColumn("sink", F.col("sink").cast("string")).withColumn("version", F.col("version").cast("bigint"))
    live = _of_live(live, shown)
    found = cells.cell_topk(queries, f"{path}/cells", k, ["source_name", "chunk_id"], rows=live, probes=probes, refine=refine)
    found = broadcast_bounded(found, queries.count() * k, 256)
    return texts.select("source_name", "chunk_id", "chunk").join(found, ["source_name", "chunk_id"]).select("query_id", "rank", "score", "source_name", "chunk_id", "chunk")


def screen_stream(
    messages: DataFrame,
    path: str,
    checkpoint: str,
    analyse: Callable[[DataFrame], DataFrame] | None = None,
    *,
    sink: str | None = None,
    once: bool = True,
) -> StreamingQuery:
    """Score arriving ``(query_id, ts, text)`` and append to the analysis log.

    Validation and routing are stateless; ``analyse`` may join the stored indexes, which
    ranks inside one micro-batch. Without it the routed messages are stored.
    """

    name = sink or _sink_name(checkpoint)

    def score(batch: DataFrame, version: int) -> None:
        _write_version((analyse or route_messages)(batch), path, version, name)

    return _start(messages, score, checkpoint, once)


def append_registry(log_rows: DataFrame, path: str, version: int, sink: str = "batch") -> None:
    """Append registry operations of one batch."""
    _write_version(log_rows, path, version, sink)


def load_registry(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """The operation log; ``tolerant`` reads an unreadable registry as an empty one."""
    return read_or_empty(spark, path, schema.REGISTRY_LOG, tolerant)


def append_history(analyses: DataFrame, path: str, version: int, sink: str = "batch") -> None:
    """Append analyses ``(ts, seq, text, label, risk_level)`` of one batch."""
    _write_version(analyses.select("ts", "seq", "text", "label", "risk_level"), path, version, sink)


def load_history(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, schema.ANALYSIS_LOG)


def append_history_days(analyses: DataFrame, path: str, version: int, sink: str = "batch") -> None:
    """Append analyses under the folder of their day, so that ``newest_history`` can read from the end.

    A batch that is replayed replaces its own folders ``day=/sink=/version=``.
    """
    rows = analyses.select("ts", "seq", "text", "label", "risk_level", F.to_date("ts").alias("day"), F.lit(sink).alias("sink"), F.lit(version).alias("version"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "sink", "version").parquet(path)


def newest_history(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The newest ``n`` analyses of a log by day, newest first: days are opened from the last until they hold ``n`` rows."""
    names = sorted((c.removeprefix("day=") for c in child_names(spark, path) if c.startswith("day=")), reverse=True)
    dated = [c for c in names if c[:1].isdigit()]
    days = dated + [c for c in names if c not in dated]  # rows without a time come last
    if not days:
        return registry.history(spark.createDataFrame([], schema.ANALYSIS_LOG))
    take, fields = 1, [f for f in schema.ANALYSIS_LOG.fields if f.name not in ("sink", "version")]
    while True:
        folders = [f"{path}/day={d}" for d in days[:take]]
        rows = spark.read.schema(T.StructType(fields)).option("recursiveFileLookup", True).parquet(*folders)
        if take >= len(days) or rows.limit(n).count() >= n:
            return registry.history(rows).limit(n)
        take *= 2
