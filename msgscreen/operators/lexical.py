"""BM25 over plain tables.

The index is four tables: ``doc_terms`` (one row per document with its term counts),
``postings`` clustered by term, ``term_stats`` and one row of ``corpus_stats``.

Three scoring plans with the same result:

* ``scan``: the query terms, measured first, go to every executor; ``doc_terms`` is
  scanned once and never shuffled, each task returns at most k rows per query. Stop
  words cost arithmetic, not shuffle.
* ``fragments``: for a query side beyond the broadcast bound. Documents are hashed by id
  into fragments of bounded bytes, queries are sent to every fragment and stream past it.
* ``join``: few query terms meet the term-clustered ``postings`` of a stored index, which
  reads a small part of them.

(query, document) pairs exist only inside a task; none of the plans shuffles them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from msgscreen import schema
from msgscreen.functions.text import split_tokens, term_counts, tokens
from msgscreen.operators.blocks import best_k, running_best
from msgscreen.scale import BROADCAST_BYTES, block_count, block_pairs, measured, merged_best, top_rows

# BM25 parameters and the share of the mean idf that floors negative ones.
K1 = 1.5
B = 0.75
IDF_FLOOR = 0.25

#: Tokens of the documents held by one fragment while its queries stream past.
FRAGMENT_TOKENS = 8_000_000

#: Bytes that a token of a document counts for when it is weighed which side of the fragments plan is copied.
TOKEN_BYTES = 16

#: Documents whose tokens are counted together, and documents whose postings of a term share a row.
COUNTED_DOCS = 2048
POSTED_DOCS = 8192

#: Below this many query-term rows the term-clustered postings are read instead of all documents.
FEW_QUERY_TERMS = 256


@dataclass(frozen=True)
class LexicalIndex:
    doc_terms: DataFrame  # doc_id, dl, terms array<struct<term, tf>>
    postings: DataFrame  # term, doc_id, tf, dl
    term_stats: DataFrame  # term, df, idf
    corpus_stats: DataFrame  # n, avgdl, avg_idf
    stored: bool = False


def build_doc_terms(docs: DataFrame, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Term counts of every document, one row each, with the columns ``keep``; no shuffle.

    Terms stand in the order of their bytes, as ``term_counts`` gives them; tokens are counted by blocks of documents.
    """
    words = docs.select("doc_id", F.lower(F.col(text)).alias("_t"), *keep)

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for part in (whole.slice(at, COUNTED_DOCS) for whole in batches for at in range(0, whole.num_rows, COUNTED_DOCS)):
            sizes, coded = split_tokens(part["_t"])
            order = pc.sort_indices(coded.dictionary).to_numpy()
            place = np.empty(len(order), "int64")
            place[order] = np.arange(len(order))
            wide = max(1, len(order))
            found, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * wide + place[coded.indices.to_numpy()], return_counts=True)
            ends = np.cumsum(np.bincount(found // wide, minlength=len(sizes)))
            pairs = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(order[found % wide])), pa.array(tf, pa.int32())], ["term", "tf"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(sizes, pa.int32()), lists, *[part[c] for c in keep]], ["doc_id", "dl", "terms", *keep])

    kind = [words.schema["doc_id"], *schema.DOC_TERMS.fields[1:], *[words.schema[c] for c in keep]]
    return words.mapInArrow(count, T.StructType(kind))


def postings_of(doc_terms: DataFrame) -> DataFrame:
    return doc_terms.select("doc_id", "dl", F.inline("terms")).select("term", "doc_id", "tf", "dl")


def posting_blocks(doc_terms: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(term, first, n, ids, tfs, dls, *by)``: postings, those of a term in neighbouring documents as one row.

    The lists go by id, ``first`` is the lowest, ``n`` their length; ``by`` names columns that are equal in a list.
    """
    rows = doc_terms.select("doc_id", "dl", "terms", *by)

    def grouped(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for part in (whole.slice(at, POSTED_DOCS) for whole in batches for at in range(0, whole.num_rows, POSTED_DOCS)):
            sizes = part["terms"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = part["terms"].flatten()
            if not len(flat):
                continue
            coded = flat.field("term").dictionary_encode()
            by_id = pc.sort_indices(part["doc_id"], null_placement="at_start").to_numpy()
            place = np.empty(len(by_id), "int64")
            place[by_id] = np.arange(len(by_id))
            group = np.zeros(len(by_id), "int64")
            for c in by:
                mark = part[c].dictionary_encode("encode")
                group = group * max(1, len(mark.dictionary)) + mark.indices.to_numpy()
            row = np.repeat(np.arange(len(by_id)), sizes)
            key = group[row] * len(coded.dictionary) + coded.indices.to_numpy()
            order = np.lexsort((place[row], key))
            key, row = key[order], row[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            ends = np.append(first[1:], len(key))
            at, head = pa.array(row), pa.array(row[first])
            offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, c) for c in (part["doc_id"].take(at), flat.field("tf").take(pa.array(order)), part["dl"].take(at))]
            terms = coded.dictionary.take(pa.array(key[first] % len(coded.dictionary)))
            yield pa.RecordBatch.from_arrays(
                [terms, part["doc_id"].take(head), pa.array(ends - first, pa.int32()), *lists, *[part[c].take(head) for c in by]],
                ["term", "first", "n", "ids", "tfs", "dls", *by],
            )

    return rows.mapInArrow(grouped, T.StructType([*schema.POSTING_BLOCKS.fields, *[rows.schema[c] for c in by]]))


def postings_in(blocks: DataFrame, *keep: str) -> DataFrame:
    """The single postings of ``posting_blocks``."""
    single = F.inline(F.arrays_zip("ids", "tfs", "dls")).alias("doc_id", "tf", "dl")
    return blocks.select("term", single, *keep)


def length_stats(doc_terms: DataFrame) -> DataFrame:
    return doc_terms.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def term_stats_of(doc_terms: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Document frequency and floored idf per term, and the mean raw idf (one row)."""
    return idf_of(document_frequencies(doc_terms), lengths.select("n").scalar())


def document_frequencies(doc_terms: DataFrame) -> DataFrame:
    return doc_terms.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf_of(counts: DataFrame, n: Column) -> tuple[DataFrame, DataFrame]:
    """``(term, df, idf)`` from ``(term, df)`` over ``n`` documents, and the mean raw idf (one row)."""
    df = F.col("df").cast("double")
    raw = counts.withColumn("raw", F.ln(n - df + 0.5) - F.ln(df + 0.5))
    mean = raw.agg(F.avg("raw").alias("avg_idf"))
    floored = F.when(F.col("raw") < 0, F.lit(IDF_FLOOR) * mean.scalar()).otherwise(F.col("raw"))
    return raw.select("term", "df", floored.alias("idf")), mean


def index_from_doc_terms(doc_terms: DataFrame) -> LexicalIndex:
    lengths = length_stats(doc_terms)
    term_stats, mean = term_stats_of(doc_terms, lengths)
    stats = lengths.withColumn("avg_idf", mean.scalar())
    return LexicalIndex(doc_terms, postings_of(doc_terms), term_stats, stats)


def build_lexical_index(docs: DataFrame, text: str = "text") -> LexicalIndex:
    """Index of ``docs(doc_id, text)`` as lazy frames; ``sources.index`` stores it."""
    return index_from_doc_terms(build_doc_terms(docs, text))


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """``(query_id, term, qtf)``; tokenising the lower-cased text equals tokenising the normalised one."""
    return (
        queries.select("query_id", F.inline(term_counts(tokens(F.lower(F.col(text))))))
        .withColumnRenamed("tf", "qtf")
    )


def query_weights(terms: DataFrame, index: LexicalIndex, small: bool) -> DataFrame:
    """``(query_id, term, w)`` with w = count in the query * idf; unknown terms drop out."""
    side = F.broadcast(terms) if small else terms
    return index.term_stats.join(side, "term").select(
        "query_id", "term", (F.col("qtf") * F.col("idf")).alias("w")
    )


def average_length(index: LexicalIndex):
    return index.corpus_stats.select("avgdl").scalar().cast("double")


def _shared_weights(terms: DataFrame, index: LexicalIndex):
    """Broadcast table ``(query_id, term, w, avgdl)``, a row for each query and term."""
    table = (
        query_weights(terms, index, True)
        .groupBy("query_id", "term").agg(F.sum("w").alias("w"))
        .withColumn("avgdl", average_length(index))
        .toArrow()  # bounded: the caller measured the query terms
    )
    return terms.sparkSession.sparkContext.broadcast(table.combine_chunks())


def _scored_by_join(terms: DataFrame, index: LexicalIndex, k: int, k1: float, b: float) -> DataFrame:
    """Postings of the query vocabulary, brought to the task of their document, which keeps k rows per query."""
    shared, collect = _shared_weights(terms, index), running_best(k)
    _, gains, by_code, scores = _block_scorer(k1, b)
    no_id = -(1 << 63)  # stands for a missing id inside the task
    vocabulary = F.broadcast(terms.select("term").distinct())

    def whole_documents(batches: Iterator) -> Iterator:
        """Batches of rows by ``doc_id``, cut where a document ends."""
        import numpy as np
        import pyarrow as pa

        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch["doc_id"].fill_null(no_id).to_numpy()
            last = int(np.searchsorted(ids, ids[-1]))
            before = held and held[-1]["doc_id"].fill_null(no_id)[0].as_py() == ids[-1]
            if last or held and not before:
                yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
                held = []
            held.append(batch.slice(last))
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def score(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        weights = shared.value
        if not weights.num_rows:
            return
        query_ids, q_no = np.unique(weights["query_id"].fill_null(no_id).to_numpy(), return_inverse=True)
        coded = pa.concat_arrays(weights["term"].chunks).dictionary_encode()
        code, w, mean = coded.indices.to_numpy(), weights["w"].to_numpy(), weights["avgdl"][0].as_py()
        groups = []
        for at in range(0, len(query_ids), 1024):
            mine = (q_no >= at) & (q_no < at + 1024)
            groups.append((at, min(1024, len(query_ids) - at), by_code(code[mine], q_no[mine] - at, w[mine])))
        add, results = collect(query_ids)
        for rows in whole_documents(batches):
            found = pc.index_in(rows["term"].combine_chunks(), value_set=coded.dictionary)
            rows = rows.append_column("code", found).filter(found.is_valid())
            ids, doc = np.unique(rows["doc_id"].fill_null(no_id).to_numpy(), return_inverse=True)
            term, tf, dl = (rows[c].to_numpy() for c in ("code", "tf", "dl"))
            gain = gains(np.arange(len(tf)), tf, dl, mean)
            for lo in range(0, len(ids), 2048):
                first, last = np.searchsorted(doc, (lo, lo + 2048))
                key = term[first:last].astype("int64") * 2048 + (doc[first:last] - lo)
                key, back = np.unique(key, return_inverse=True)
                total = np.bincount(back, gain[first:last], len(key))  # rows that share an id add up
                documents, block = by_code(key // 2048, key % 2048, total), ids[lo : lo + 2048]
                for at, size, queries in groups:
                    add(at, block, scores(queries, documents, (size, len(block))))
        for batch in results():
            marked = [pc.if_else(pc.equal(batch[c], no_id), None, batch[c]) for c in ("query_id", "doc_id")]
            yield pa.RecordBatch.from_arrays([*marked, batch["score"]], ["query_id", "doc_id", "score"])

    met = index.postings.join(vocabulary, "term", "left_semi").repartition("doc_id").sortWithinPartitions("doc_id")
    return met.select("term", "doc_id", "tf", "dl").mapInArrow(score, "query_id bigint, doc_id bigint, score double")


def _block_scorer(k1: float, b: float):
    """Dense scores of a block: a few hundred queries against the documents of a task."""

    def flatten(column, value: str):
        """List column of (term, value) structs -> row number, term, value."""
        import numpy as np

        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = column.flatten()
        rows = np.repeat(np.arange(len(column)), sizes)
        return rows, flat.field("term"), flat.field(value).to_numpy(zero_copy_only=False)

    def gains(doc, tf, dl, mean):
        """Length-normalised term frequency of every posting."""
        tf = tf.astype("float64")
        return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[doc].astype("float64") / mean))

    def by_code(code, *columns):
        """Sort columns by term code; returns them and where each code begins."""
        import numpy as np

        order = np.argsort(code, kind="stable")
        code = code[order]
        codes = np.unique(code)
        return codes, np.searchsorted(code, codes), np.searchsorted(code, codes, "right"), [c[order] for c in columns]

    def scores(queries, documents, shape):
        """Sum weight * gain over the shared terms; pairs without one stay at minus infinity."""
        import numpy as np

        total, hit = np.zeros(shape), np.zeros(shape, dtype=bool)
        q_codes, q_from, q_to, (q, w) = queries
        d_codes, d_from, d_to, (d, gain) = documents
        _, at_q, at_d = np.intersect1d(q_codes, d_codes, assume_unique=True, return_indices=True)
        for i, j in zip(at_q, at_d):
            qs, ds = slice(q_from[i], q_to[i]), slice(d_from[j], d_to[j])
            cell = np.ix_(q[qs], d[ds])
            total[cell] += w[qs, None] * gain[None, ds]
            hit[cell] = True
        total[~hit] = -np.inf
        return total

    return flatten, gains, by_code, scores


def _scored_by_scan(terms: DataFrame, index: LexicalIndex, k: int, k1: float, b: float) -> DataFrame:
    table = (
        query_weights(terms, index, True)
        .withColumn("avgdl", average_length(index))
        .toArrow()  # bounded: the caller measured the query terms
    )
    shared = index.doc_terms.sparkSession.sparkContext.broadcast(table.combine_chunks())
    collect = running_best(k)
    flatten, gains, by_code, scores = _block_scorer(k1, b)

    def scan(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        weights = shared.value
        if not weights.num_rows:
            return
        query_ids, q_no = np.unique(weights["query_id"].to_numpy(), return_inverse=True)
        coded = pa.concat_arrays(weights["term"].chunks).dictionary_encode()
        code, w = coded.indices.to_numpy(), weights["w"].to_numpy()
        mean = weights["avgdl"][0].as_py()
        groups = []
        for at in range(0, len(query_ids), 1024):
            mine = (q_no >= at) & (q_no < at + 1024)
            groups.append((at, min(1024, len(query_ids) - at), by_code(code[mine], q_no[mine] - at, w[mine])))
        add, results = collect(query_ids)
        for batch in batches:
            for part in range(0, batch.num_rows, 2048):
                rows = batch.slice(part, 2048)
                doc, term, tf = flatten(rows["terms"], "tf")
                found = pc.index_in(term, value_set=coded.dictionary)
                known = found.is_valid().to_numpy(zero_copy_only=False)
                if not known.any():
                    continue
                doc, ids = doc[known], rows["doc_id"].to_numpy()
                gain = gains(doc, tf[known], rows["dl"].to_numpy(), mean)
                documents = by_code(found.drop_null().to_numpy(), doc, gain)
                for at, size, queries in groups:
                    add(at, ids, scores(queries, documents, (size, len(ids))))
        yield from results()

    return index.doc_terms.mapInArrow(scan, "query_id bigint, doc_id bigint, score double")


def _token_count(index: LexicalIndex) -> int:
    """From the lengths alone; the term lists are not read for it."""
    return index.doc_terms.agg(F.sum(F.col("dl").cast("bigint"))).first()[0] or 0


def cut_to_vocabulary(doc_terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``doc_terms`` without the terms that ``vocabulary(term)`` lacks, and without documents that are left with none.

    Lengths stay those of the whole texts, so scores stay the same. Nothing is cut by a vocabulary beyond the broadcast bound.
    """
    doc_terms = doc_terms.select("doc_id", "dl", "terms", *[c for c in doc_terms.columns if c not in ("doc_id", "dl", "terms")])
    if measured(vocabulary)[1] > BROADCAST_BYTES:
        return doc_terms
    shared = doc_terms.sparkSession.sparkContext.broadcast(vocabulary.select("term").toArrow()["term"].combine_chunks())

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known = shared.value
        known = pa.concat_arrays(known.chunks) if isinstance(known, pa.ChunkedArray) else known
        for batch in batches:
            sizes = batch["terms"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = batch["terms"].flatten()
            keep = pc.is_in(flat.field("term"), value_set=known)
            left = np.bincount(np.repeat(np.arange(batch.num_rows), sizes)[keep.to_numpy(zero_copy_only=False)], minlength=batch.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(left))), pa.int32()), flat.filter(keep))
            at = batch.schema.get_field_index("terms")
            yield pa.RecordBatch.from_arrays([lists if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names).filter(pa.array(left > 0))

    return doc_terms.mapInArrow(cut, doc_terms.schema)


_SIDE_TERMS = "array<struct<term:string,tf:int,w:double>>"


def document_side(doc_terms: DataFrame, *keep: str) -> DataFrame:
    """Documents as ``stream_scorer`` takes them."""
    nothing = F.lit(None).cast("double")
    listed = F.transform("terms", lambda t: F.struct(t["term"].alias("term"), t["tf"].alias("tf"), nothing.alias("w")))
    return doc_terms.select(
        "doc_id", F.lit(0).alias("side"), F.col("doc_id").alias("id"), "dl", nothing.alias("avgdl"), listed.cast(_SIDE_TERMS).alias("terms"), *keep
    )


def query_side(weights: DataFrame, average: Column) -> DataFrame:
    """Queries as ``stream_scorer`` takes them; a list is as long as its message has distinct words."""
    no_count = F.lit(None).cast("int")
    listed = weights.groupBy("query_id").agg(F.collect_list(F.struct("term", no_count.alias("tf"), "w")).cast(_SIDE_TERMS).alias("terms"))
    return listed.select(
        "query_id", F.lit(1).alias("side"), F.col("query_id").alias("id"), no_count.alias("dl"), average.alias("avgdl"), "terms"
    )


def _scored_by_fragments(
    terms: DataFrame, index: LexicalIndex, k: int, k1: float, b: float, fragments: int, blocks: int, small: bool
) -> DataFrame:
    """One shuffle by (fragment, query block); inside a partition documents come first, then queries stream past.

    Of a document only the terms that some query asks for travel.
    """
    asked = query_side(query_weights(terms, index, small), average_length(index))
    docs = document_side(cut_to_vocabulary(index.doc_terms, terms.select("term").distinct()))
    asked, docs = block_pairs(asked, docs, fragments, blocks)
    ordered = (
        docs.drop("doc_id").unionByName(asked.drop("query_id"))
        .repartitionById(fragments * blocks, F.col("frag"))  # one pair of blocks per task, no collisions
        .sortWithinPartitions("frag", "side")
    )
    return ordered.mapInArrow(stream_scorer(k, k1, b), "query_id bigint, doc_id bigint, score double")


def stream_scorer(k: int, k1: float, b: float):
    """Arrow task over rows sorted by (frag, side): the documents of a fragment are held while its queries pass."""
    best = best_k(k)
    flatten, gains, by_code, scores = _block_scorer(k1, b)

    def stream(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        current, held, block = None, [], None
        for batch in batches:
            frag, side = batch["frag"].to_numpy(), batch["side"].to_numpy()
            edges = np.flatnonzero((np.diff(frag) != 0) | (np.diff(side) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(frag)]):
                if lo == hi:
                    continue
                if frag[lo] != current:
                    current, held, block = frag[lo], [], None
                rows = batch.slice(lo, hi - lo)
                if side[lo] == 0:
                    held.append(rows)
                    continue
                if block is None:
                    if not held:
                        continue
                    mine = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    doc, term, tf = flatten(mine["terms"], "tf")
                    coded = term.dictionary_encode()
                    gain = gains(doc, tf, mine["dl"].to_numpy(), rows["avgdl"][0].as_py())
                    block = (mine["id"].to_numpy(), coded.dictionary, by_code(coded.indices.to_numpy(), doc, gain))
                    held = []
                ids, vocabulary, documents = block
                step = max(1, (1 << 22) // len(ids))
                for at in range(0, rows.num_rows, step):
                    part = rows.slice(at, step)
                    q, term, w = flatten(part["terms"], "w")
                    found = pc.index_in(term, value_set=vocabulary)
                    known = found.is_valid().to_numpy(zero_copy_only=False)
                    if not known.any():
                        continue
                    queries = by_code(found.drop_null().to_numpy(), q[known], w[known])
                    line, docs_, top = best(ids, scores(queries, documents, (part.num_rows, len(ids))))
                    yield pa.record_batch(
                        [pa.array(part["id"].to_numpy()[line]), pa.array(docs_), pa.array(top)],
                        names=["query_id", "doc_id", "score"],
                    )

    return stream


def bm25_topk(
    queries: DataFrame,
    index: LexicalIndex,
    k: int = 20,
    *,
    text: str = "text",
    pad: bool = False,
    plan: str = "auto",
    fragments: int | None = None,
    blocks: int | None = None,
    k1: float = K1,
    b: float = B,
) -> DataFrame:
    """``(query_id, doc_id, rank, score)``: best k documents per query.

    Scores are rounded to 6 digits before ranking; ties go to the lower ``doc_id``.
    Only documents that share a term with the query are listed; ``pad`` fills short
    lists with zero-score documents, lowest ids first. ``fragments`` is a least number: no
    fragment holds many more than ``FRAGMENT_TOKENS`` tokens.
    """
    terms = query_terms(queries, text)
    tasks = 1
    rows, size = measured(terms)
    if plan == "auto":
        few = index.stored and rows <= FEW_QUERY_TERMS
        plan = "join" if few else "scan" if size <= BROADCAST_BYTES else "fragments"
    if plan in ("scan", "join"):
        # Query sides beyond the bound go in batches of whole queries that fit, one scan each.
        batches = max(1, math.ceil(size / BROADCAST_BYTES))
        part = F.pmod(F.xxhash64("query_id"), F.lit(batches))
        sides = [terms.where(part == i) for i in range(batches)] if batches > 1 else [terms]
        one = (lambda t: _scored_by_scan(t, index, k, k1, b)) if plan == "scan" else (lambda t: _scored_by_join(t, index, k, k1, b))
        scored = reduce(DataFrame.unionByName, [one(t) for t in sides])
    elif plan == "fragments":
        length = _token_count(index)
        count, per = max(fragments or 1, math.ceil(length / FRAGMENT_TOKENS)), blocks or block_count(size)
        tasks = count * per
        if size * count < length * TOKEN_BYTES:  # copying the queries to smaller fragments costs less than copying documents to each block
            count, per = tasks, 1
        scored = _scored_by_fragments(terms, index, k, k1, b, count, per, size <= BROADCAST_BYTES)
    else:
        raise ValueError(f"unknown plan {plan!r}")
    order = [F.desc("score"), F.asc("doc_id")]
    if not pad:
        return merged_best(scored, k, tasks)
    # Fewer than k documents match a short list, so among the 2k lowest ids at least k do not.
    lowest = index.doc_terms.select("doc_id").orderBy("doc_id").limit(2 * k)
    fill = queries.select(
        "query_id", F.explode(lowest.agg(F.collect_list("doc_id")).scalar()).alias("doc_id")
    ).withColumn("score", F.lit(0.0))
    best = top_rows(scored, ["query_id"], order, k).drop("rank")
    # A filler that duplicates a match loses to it: keep the larger score of each pair.
    merged = best.unionByName(fill).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return top_rows(merged, ["query_id"], order, k).select("query_id", "doc_id", "rank", "score")
