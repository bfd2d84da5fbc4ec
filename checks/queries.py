"""The registered queries: one per operator, over whole tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views as V
from msgscreen import schema, scale
from msgscreen.functions import lexicons, text, url, vectors, verdict
from msgscreen.operators import (
    ann,
    chunking,
    class_eval,
    context,
    dense,
    fusion,
    lexical,
    long_lexicon,
    profile,
    pruned,
    registry,
    retrieval_eval,
    sampling,
)
from msgscreen.plans import retrieve, screen
from msgscreen.sources import corpus as corpus_source
from msgscreen.sources import index as index_source
from msgscreen.sources import registry_store, segments
from msgscreen.sources import vectors as vector_source
from msgscreen.streaming import arrivals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


# --- lexical -------------------------------------------------------------------------

@query
def bm25_postings_stats(spark, d):
    index, _ = V.retrieval_system(spark, d)
    return index.postings.groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("total_tf"), F.max("dl").cast("bigint").alias("longest")
    )


@query
def bm25_idf(spark, d):
    stats = lexical.build_lexical_index(V.documents(spark, d)).term_stats
    return stats.select("term", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_corpus_stats(spark, d):
    stats = V.retrieval_system(spark, d)[0].corpus_stats
    return stats.select("n", F.round("avgdl", 6).alias("avgdl"), F.round("avg_idf", 6).alias("avg_idf"))


@query
def bm25_topk(spark, d):
    index, _ = V.retrieval_system(spark, d)
    return lexical.bm25_topk(V.queries(spark, d), index, plan="scan")


@query
def bm25_topk_joined(spark, d):
    index, _ = V.retrieval_system(spark, d)
    return lexical.bm25_topk(V.queries(spark, d), index, plan="join")


@query
def bm25_topk_blocked(spark, d):
    index, _ = V.retrieval_system(spark, d)
    return lexical.bm25_topk(V.queries(spark, d), index, plan="fragments", fragments=8, blocks=4)


@query
def bm25_topk_padded(spark, d):
    pages = V.table(spark, d, "pages").select((F.col("page_id") + 1_000_000).alias("query_id"), F.col("url").alias("text"))
    index, _ = V.retrieval_system(spark, d)
    return lexical.bm25_topk(V.queries(spark, d).unionByName(pages), index, pad=True)


@query
def bm25_pruned(spark, d):
    return pruned.bm25_pruned(V.queries(spark, d), V.block_index(spark, d))


@query
def bm25_incremental(spark, d):
    """Files added, changed and removed, documents removed by id: as if the index were new."""
    index = segments.lexical_index(spark, V.changed_store(spark, d))
    return lexical.bm25_topk(V.queries(spark, d), index, plan="scan")


@query
def bm25_incremental_idf(spark, d):
    stats = segments.load_version(spark, V.changed_store(spark, d)).term_stats
    return stats.select("term", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_compacted_stats(spark, d):
    """Postings of a store after its segments were merged."""
    store = V.changed_store(spark, d, postings=True)
    segments.compact(spark, store)
    return segments.lexical_index(spark, store).postings.groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("total_tf"), F.max("dl").cast("bigint").alias("longest")
    )


# --- dense ---------------------------------------------------------------------------

def _encoded(spark, d):
    queries = V.ENCODER.encode(V.queries(spark, d), "text", keep=["query_id"])
    docs = V.ENCODER.encode(V.documents(spark, d), "text", keep=["doc_id"])
    return queries, docs


@query
def dense_topk(spark, d):
    return dense.dense_topk(*_encoded(spark, d), plan="broadcast")


@query
def dense_topk_stored(spark, d):
    """Queries encoded, documents as their vectors were stored."""
    _, stored = V.retrieval_system(spark, d)
    return dense.dense_topk(V.ENCODER.encode(V.queries(spark, d), "text", keep=["query_id"]), stored)


@query
def dense_topk_blocked(spark, d):
    return dense.dense_topk(*_encoded(spark, d), plan="fragments", fragments=8, blocks=4)


@query
def dense_topk_pruned(spark, d):
    """Neighbours of every vector, from the cells whose bound can hold them."""
    queries = V.labelled_vectors(spark, d).select(F.col("doc_id").alias("query_id"), "embedding")
    return pruned.dense_pruned(queries, V.cell_store(spark, d), 5, exclude_self=True)


def _by_label(spark, d):
    """Cells around the lowest id of each label: centroids that SQL can name."""
    corpus = V.labelled_vectors(spark, d)
    first = scale.top_rows(corpus, ["label"], [F.asc("doc_id")], 1).select(F.col("label").alias("cell"), "embedding")
    vectors = corpus.select("doc_id", "embedding")
    queries = vectors.withColumnRenamed("doc_id", "query_id")
    return ann.ann_topk(queries, ann.cells_of(vectors, first), k=5, probes=3, exclude_self=True)


@query
def dense_topk_ann_by_label(spark, d):
    return _by_label(spark, d)


@query
def ann_recall(spark, d):
    per_query = ann.recall_against(_by_label(spark, d), knn_leave_one_out(spark, d))
    return per_query.agg(F.round(F.avg("recall"), 6).alias("recall"), F.count("*").alias("queries"))


@query
def dense_topk_ann_every_cell(spark, d):
    """Probing every cell must give the exact result."""
    corpus = V.labelled_vectors(spark, d).select("doc_id", "embedding")
    queries = corpus.withColumnRenamed("doc_id", "query_id")
    return ann.ann_topk(queries, ann.build_cells(corpus, cells=8), k=5, probes=8, exclude_self=True)


@query
def embed_documents(spark, d):
    embedded = V.ENCODER.encode(V.documents(spark, d), "text", keep=["doc_id"])
    return embedded.select("doc_id", F.posexplode("embedding").alias("pos", "value")).where("value > 0").select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), F.round(F.col("value").cast("double"), 6).alias("value")
    )


@query
def embed_incremental(spark, d):
    """A part of the documents first, then all of them: each text is encoded once."""
    home = scale.scratch_path(spark, "vectors")
    docs = V.documents(spark, d)
    vector_source.encode_once(docs.where("doc_id % 3 = 0"), V.ENCODER, home)
    embedded = vector_source.encode_once(docs, V.ENCODER, home).drop("text")
    return embedded.select("doc_id", F.posexplode("embedding").alias("pos", "value")).where("value > 0").select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), F.round(F.col("value").cast("double"), 6).alias("value")
    )


@query
def l2_normalise(spark, d):
    scaled = V.table(spark, d, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: (x * F.col("label")).cast("float")).alias("v")
    )
    return scaled.select("vec_id", F.posexplode(vectors.l2_normalise(F.col("v"))).alias("pos", "value")).select(
        "vec_id", F.col("pos").cast("bigint").alias("pos"), F.round(F.col("value").cast("double"), 6).alias("value")
    )


@query
def knn_leave_one_out(spark, d):
    corpus = V.labelled_vectors(spark, d)
    queries = corpus.select(F.col("doc_id").alias("query_id"), "embedding")
    return retrieve.knn_leave_one_out(queries, corpus, 5)


@query
def index_size(spark, d):
    return dense.index_size_mb(V.labelled_vectors(spark, d), ["label"])


# --- fusion --------------------------------------------------------------------------

@query
def rrf_fuse(spark, d):
    docs = V.table(spark, d, "documents").select(F.col("source").alias("query_id"), "doc_id", "n_chars")
    longest = scale.top_rows(docs, ["query_id"], [F.desc("n_chars"), F.asc("doc_id")], 20)
    drawn = scale.top_rows(docs, ["query_id"], [F.asc(F.md5(F.col("doc_id").cast("string")))], 20)
    return fusion.rrf_fuse([longest, drawn], 10).withColumn("rrf_score", F.round("rrf_score", 9))


@query
def hybrid_search(spark, d):
    index, stored = V.retrieval_system(spark, d)
    run = retrieve.hybrid_search(V.queries(spark, d), index, stored, V.ENCODER)
    return run.withColumn("rrf_score", F.round("rrf_score", 9))


def _cases(spark, d):
    index, stored = V.retrieval_system(spark, d)
    queries = V.queries(spark, d)
    rows = queries.count()
    run = retrieve.hybrid_search(queries, index, stored, V.ENCODER, query_rows=rows)
    return fusion.gather(run, V.corpus(spark, d), rows * retrieve.FINAL)


@query
def similar_cases(spark, d):
    listed = fusion.similar_cases(_cases(spark, d))
    return listed.select("query_id", "retrieved_examples", F.posexplode("similar_cases").alias("pos", "c")).select(
        "query_id", F.col("retrieved_examples").cast("bigint").alias("retrieved_examples"),
        F.col("pos").cast("bigint").alias("pos"), text.preview(F.col("c.text"), registry.CASE_PREVIEW).alias("preview"), "c.text",
        "c.label", "c.language", "c.attack_type", "c.risk_level", "c.channel",
    )


@query
def gather_cases(spark, d):
    """Winners out of a case table of many folders."""
    index, stored = V.retrieval_system(spark, d)
    path = scale.scratch_path(spark, "cases")
    index_source.save_cases(V.corpus(spark, d), path, 64)
    queries = V.queries(spark, d)
    rows = queries.count()
    run = retrieve.hybrid_search(queries, index, stored, V.ENCODER, query_rows=rows)
    found = fusion.gather(run, index_source.load_cases(spark, path), rows * retrieve.FINAL, parts=64)
    return found.select("query_id", "rank", "doc_id", "text", "label", "language", "attack_type", "risk_level", "channel")


@query
def context_block(spark, d):
    return context.context_blocks(_cases(spark, d))


@query
def context_block_spaced(spark, d):
    return context.context_blocks(_cases(spark, d), "spaced")


# --- text and URLs -------------------------------------------------------------------

@query
def normalise_text(spark, d):
    docs = V.table(spark, d, "documents")
    return docs.select(
        "doc_id", text.normalise(F.col("text")).alias("norm_text"),
        F.size(text.tokens(F.col("text"))).cast("bigint").alias("n_tokens"),
    )


@query
def load_corpus(spark, d):
    path = scale.scratch_path(spark, "corpus")
    full = corpus_source.with_norm_text(V.corpus(spark, d)).withColumn(
        "norm_text", F.when(F.col("doc_id") % 7 != 0, F.col("norm_text"))
    )
    corpus_source.write_table(full.select(*schema.CORPUS.fieldNames()), path)
    loaded = corpus_source.load_corpus(spark, path)
    return loaded


@query
def corpus_header_rows(spark, d):
    """CSV files whose column names stand in the second record, below a preamble."""
    path = scale.scratch_path(spark, "csv")
    names = schema.CORPUS.fieldNames()
    full = corpus_source.with_norm_text(V.corpus(spark, d)).select(*[F.col(n).cast("string").alias(n) for n in names])
    files = max(4, -(-full.count() // 50_000))
    above = [[i, o, *line] for i in range(files) for o, line in ((0, ["exported corpus", "preamble", *[None] * (len(names) - 2)]), (1, names))]
    top = spark.createDataFrame(above, "_f int, _o int, " + ", ".join(f"`{n}` string" for n in names))
    rows = top.unionByName(full.withColumns({"_f": F.pmod(F.xxhash64("doc_id"), F.lit(files)).cast("int"), "_o": F.lit(2)}))
    lines = rows.repartitionById(files, F.col("_f")).sortWithinPartitions("_o").drop("_f", "_o")
    lines.write.option("header", False).option("escape", '"').option("quoteAll", True).option("emptyValue", "").option("nullValue", "").csv(path)
    return corpus_source.load_corpus(spark, path, "csv", header_row=1).select("doc_id", "label", "language", "channel", "norm_text")


@query
def validate_messages(spark, d):
    turns = V.table(spark, d, "conversations")
    whole = turns.select("conv_id", "turn", F.concat(F.lit("  "), "text", F.lit("\n")).alias("text"))
    # Besides, messages that are empty or too short.
    short = turns.select(
        F.col("conv_id"), (F.col("turn") + 1000).alias("turn"),
        F.concat(F.lit(" "), F.left(F.md5("text"), (F.col("turn") % 7).cast("int")), F.lit("\t")).alias("text"),
    )
    return text.validate_messages(whole.unionByName(short))


@query
def url_detect(spark, d):
    rows = V.urls(spark, d).select("page_id", "variant", "url").unionByName(
        V.table(spark, d, "conversations").select(
            F.col("conv_id").alias("page_id"), (F.col("turn") + 100).alias("variant"), F.col("text").alias("url")
        )
    )
    return rows.select(
        "page_id", "variant", url.is_url(F.col("url")).alias("is_url"), url.is_url(F.col("url"), True).alias("is_url_strict")
    )


def _feature_rows(df, **options):
    wide = df.withColumn("f", url.url_features(F.col("url"), **options))
    numbers = ["url_length", "dash_count", "subdomain_count"]
    return wide.select(
        "page_id", "variant",
        *[F.col(f"f.{n}").cast("bigint").alias(n) for n in numbers],
        *[f"f.{n}" for n in ("domain", "subdomain", "path", "scheme", "has_ip", "has_at", "is_https", "suspicious_tld")],
        F.array_join("f.suspicious_words", ",").alias("words"),
    )


@query
def url_features(spark, d):
    return _feature_rows(V.urls(spark, d))


@query
def url_features_strict(spark, d):
    return _feature_rows(V.urls(spark, d), assume_scheme=True, distinct_words=True)


@query
def url_features_small_lists(spark, d):
    return _feature_rows(V.urls(spark, d), words=lexicons.SMALL_WORDS, tlds=lexicons.SMALL_TLDS)


@query
def url_features_text(spark, d):
    features = url.url_features(F.col("url"))
    return V.urls(spark, d).select(
        "page_id", "variant", url.features_to_text(features).alias("en"), url.features_to_text(features, "fr").alias("fr")
    )


@query
def lexicon_hits(spark, d):
    hits = V.urls(spark, d).select(F.explode(url.lexicon_hits(F.col("url"))).alias("word"))
    return hits.groupBy("word").agg(F.count("*").alias("n"))


@query
def long_lexicon_hits(spark, d):
    """A list of every word of the benchmark texts, looked for in all URLs and benchmark texts."""
    words = V.queries(spark, d).select(F.explode(text.tokens(F.lower("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("pos"))
    texts = V.urls(spark, d).select("page_id", "variant", F.col("url").alias("text")).unionByName(
        V.queries(spark, d).select(F.col("query_id").alias("page_id"), F.lit(100).cast("bigint").alias("variant"), "text")
    )
    hits = long_lexicon.long_lexicon_hits(texts, words)
    return hits.groupBy("page_id", "variant").agg(F.count("*").alias("n"), F.sum(F.length("word")).alias("letters"), F.min("word").alias("first"))


@query
def route_messages(spark, d):
    messages = V.user_turns(spark, d).unionByName(
        V.urls(spark, d).select((F.col("page_id") * 10 + F.col("variant") + 100_000_000).alias("query_id"), F.col("url").alias("text"))
    )
    return screen.route_messages(messages).select("query_id", "error", "channel", "is_url", "search_text")


# --- profile -------------------------------------------------------------------------

@query
def corpus_profile(spark, d):
    return profile.corpus_profile(V.corpus(spark, d))


@query
def channel_counts(spark, d):
    return profile.count_by(V.corpus(spark, d), "channel")


@query
def attack_counts(spark, d):
    return profile.count_by(V.corpus(spark, d), "attack_type")


@query
def language_counts(spark, d):
    return profile.language_counts(V.corpus(spark, d))


@query
def label_distribution(spark, d):
    return class_eval.label_distribution(V.corpus(spark, d), "label")


@query
def languages(spark, d):
    return class_eval.languages(V.predictions(spark, d))


# --- verdicts ------------------------------------------------------------------------

@query
def verdict_extract(spark, d):
    raw = F.col("raw")
    return V.responses(spark, d).select(
        "query_id", *[verdict.extract_json(raw, mode).alias(mode) for mode in ("fenced", "greedy", "fallback")]
    )


@query
def verdict_normalise(spark, d):
    rows = verdict.normalise_verdicts(V.responses(spark, d))
    return rows.select(
        "query_id", "error_type", "label", "classification", "confidence", F.col("confidence_pct").cast("bigint").alias("confidence_pct"),
        "risk_score", "risk_level", "attack_type", "explanation", "answer_language", "recommendations", "risk_consistent",
        F.array_join("suspicious_elements", ",").alias("elements"),
    )


@query
def verdict_two_way(spark, d):
    rows = verdict.normalise_verdicts(V.responses(spark, d), labels="two", round_confidence=False)
    return rows.select("query_id", "label", F.round("confidence", 6).alias("confidence"))


@query
def risk_bands(spark, d):
    rows = verdict.normalise_verdicts(V.responses(spark, d))
    return rows.groupBy("risk_level", "label").agg(F.count("*").alias("n"), F.sum("risk_score").alias("risk"))


@query
def verdict_errors(spark, d):
    rows = verdict.normalise_verdicts(V.responses(spark, d), mode="fallback")
    return rows.where("error_type IS NOT NULL").groupBy("error_type").agg(F.count("*").alias("n"))


@query
def prediction_rows(spark, d):
    truth = V.corpus(spark, d).select(F.col("doc_id").alias("query_id"), F.col("label").alias("true_label"), "language")
    answers = verdict.normalise_verdicts(V.responses(spark, d), mode="fallback")
    rows = verdict.prediction_rows(answers.join(truth, "query_id"))
    return rows.select(
        "model", "true_label", "pred_label", "confidence", "risk_score", "attack_type", "recommendation", "explanation",
        "suspicious", "response_time", "language",
    )


# --- samples and retrieval metrics -----------------------------------------------------

@query
def sample_simple(spark, d):
    return sampling.simple_sample(V.table(spark, d, "documents").select("doc_id", "lang"), 100)


@query
def sample_head(spark, d):
    rows = sampling.stratified_sample(V.corpus(spark, d).select("doc_id", "label"), 50)
    return sampling.head(rows, 100, "doc_id").select("doc_id", "label")


@query
def sample_stratified(spark, d):
    return sampling.stratified_sample(V.corpus(spark, d).select("doc_id", "label"), 50)


@query
def sample_threshold(spark, d):
    """More rows a class than a ranking should hold: by the hash that the n-th row has."""
    return sampling.threshold_sample(V.corpus(spark, d).select("doc_id", "label"), 300)


@query
def retrieval_metrics(spark, d):
    corpus = V.labelled_vectors(spark, d)
    queries = corpus.select(F.col("doc_id").alias("query_id"), "embedding", "label")
    run = retrieve.knn_leave_one_out(queries, corpus, 5)
    per_query = retrieval_eval.query_metrics(run, queries.select("query_id", "label"), corpus.select("doc_id", "label"), 5)
    return per_query.select("query_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "hit", "rr", "ndcg")])


@query
def retrieval_benchmark(spark, d):
    corpus = V.labelled_vectors(spark, d)
    # A second "model": the first half of every vector, normalised again.
    half = corpus.withColumn("embedding", vectors.l2_normalise(F.slice("embedding", 1, 32)))
    return retrieve.retrieval_benchmark({"full": corpus, "half": half})


# --- classification metrics ------------------------------------------------------------

@query
def confusion_matrix(spark, d):
    return class_eval.confusion_matrix(V.predictions(spark, d))


@query
def classification_summary(spark, d):
    return class_eval.summary(V.predictions(spark, d))


@query
def classification_by_language(spark, d):
    return class_eval.by_language(V.predictions(spark, d))


@query
def classification_report(spark, d):
    return class_eval.report(V.predictions(spark, d))


@query
def prediction_crosstab(spark, d):
    return class_eval.crosstab(V.predictions(spark, d))


# --- knowledge base --------------------------------------------------------------------

@query
def accepted_names(spark, d):
    names = V.urls(spark, d).select(
        "page_id", "variant", F.concat(F.element_at(F.split("url", "/"), -1), F.when(F.col("page_id") % 2 == 0, ".pdf").otherwise("")).alias("name")
    )
    return chunking.accepted_names(names)


@query
def chunk_documents(spark, d):
    docs = V.documents(spark, d).withColumn("source_name", F.col("doc_id").cast("string"))
    return chunking.chunk_documents(docs)


@query
def assemble_pages(spark, d):
    return chunking.assemble_pages(V.doc_pages(spark, d))


@query
def chunk_pages(spark, d):
    return chunking.chunk_pages(V.host_pages(spark, d))


@query
def kb_search(spark, d):
    """The stored knowledge base: chunks were encoded when they were added."""
    chunks = arrivals.load_chunks(spark, V.knowledge_base(spark, d))
    return retrieve.knowledge_search(V.queries(spark, d), chunks, V.ENCODER)


@query
def kb_search_cells(spark, d):
    """The same out of the stored cells: all of them probed, and enough finalists, it must be the exact result."""
    asked = V.ENCODER.encode(V.queries(spark, d), "text", keep=["query_id"])
    return arrivals.chunk_hits(asked, V.knowledge_base(spark, d), retrieve.KNOWLEDGE, probes=16, refine=400)


@query
def registry_latest(spark, d):
    return registry.latest(V.registry_log(spark, d))


@query
def registry_active(spark, d):
    return registry.active(V.registry_log(spark, d))


@query
def registry_listing(spark, d):
    return registry.listing(V.registry_log(spark, d))


@query
def registry_delete(spark, d):
    requests = V.table(spark, d, "customer").select(
        F.concat(F.lit("doc"), F.col("c_custkey").cast("string"), F.lit(".pdf")).alias("name"),
        F.lit("2025-01-01 00:00:00").cast("timestamp_ntz").alias("requested_at"),
        F.col("c_custkey").alias("seq"),
    )
    return registry.delete_rows(V.registry_log(spark, d), requests)


@query
def registry_status(spark, d):
    return registry.status(V.registry_log(spark, d), profile.corpus_profile(V.corpus(spark, d)))


@query
def visible_chunks(spark, d):
    docs = V.documents(spark, d).withColumn(
        "source_name", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    )
    return registry.visible_chunks(chunking.chunk_documents(docs), V.registry_log(spark, d)).select("source_name", "chunk_id")


# --- history, prompts, screening ---------------------------------------------------------

@query
def history_recent(spark, d):
    return registry.history(V.analysis_log(spark, d))


@query
def prompt_table(spark, d):
    cases = context.context_blocks(_cases(spark, d))
    return context.prompts(V.queries(spark, d), cases, template=context.TEMPLATES["cases_only"])


@query
def knowledge_block(spark, d):
    return context.knowledge_blocks(V.queries(spark, d).select("query_id"), kb_search(spark, d))


@query
def screen_messages(spark, d):
    """Messages and links, with cases, knowledge, prompts and answers."""
    index, stored = V.retrieval_system(spark, d)
    messages = V.messages(spark, d)
    raw = V.responses(spark, d)
    answers = raw.unionByName(raw.withColumn("query_id", F.col("query_id") + 1_000_000_000)).join(messages.select("query_id"), "query_id", "left_semi")
    chunks = arrivals.load_chunks(spark, V.knowledge_base(spark, d))
    rows = screen.screen_messages(
        messages, V.case_table(spark, d), index, stored, V.ENCODER, answers, chunks=chunks, case_parts=V.CASE_PARTS
    )
    return rows.select(
        "query_id", "channel", "label", "risk_level", F.col("confidence_pct").cast("bigint").alias("confidence_pct"),
        F.col("retrieved_examples").cast("bigint").alias("retrieved_examples"),
        F.array_join(F.transform("similar_cases", lambda c: F.coalesce(c["label"], F.lit("-"))), ",").alias("case_labels"),
        "search_text", "knowledge", "prompt",
    )


# --- arrivals ----------------------------------------------------------------------------

def _stream(spark, d, name):
    kind = V.table(spark, d, name).schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{d}/{name}*.parquet")


@query
def kb_ingest_stream(spark, d):
    home = scale.scratch_path(spark, "kb")
    docs = _stream(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source_name"), "text")
    arrivals.ingest_documents(docs, home, f"{home}-checkpoint", V.ENCODER).awaitTermination()
    return arrivals.load_chunks(spark, home).select("source_name", "chunk_id", "chunk")


@query
def kb_pages_stream(spark, d):
    """Pages of all documents in odd order over several batches."""
    home = scale.scratch_path(spark, "kb-pages")
    pages = V.doc_pages(spark, d)
    counted = pages.groupBy("name").agg(F.count("*").alias("n_pages"))
    dealt = pages.join(counted, "name").withColumn("_f", F.pmod(F.xxhash64("name", "page_no"), F.lit(4)).cast("int"))
    dealt.repartitionById(4, F.col("_f")).drop("_f").write.parquet(f"{home}/pages")
    kind = spark.read.parquet(f"{home}/pages").schema
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{home}/pages")
    stored = lambda: spark.read.schema(kind).parquet(f"{home}/pages")
    arrivals.ingest_pages(stream, stored, f"{home}/kb", f"{home}/checkpoint", V.ENCODER).awaitTermination()
    return arrivals.load_chunks(spark, f"{home}/kb").select("source_name", "chunk_id", "chunk")


@query
def kb_two_sources(spark, d):
    """Two sources under one folder: names re-added, emptied, given twice, deleted."""
    home = scale.scratch_path(spark, "kb")
    docs = V.documents(spark, d).withColumn("source_name", F.col("doc_id").cast("string"))
    day = lambda n: dt.datetime(2025, 1, n)
    arrivals.add_documents(docs.select("source_name", "text"), home, V.ENCODER, 0, sink="first", added_at=day(1))
    again = docs.where("doc_id % 3 = 0").select(
        "source_name", F.when(F.col("doc_id") % 2 == 0, "gone").otherwise(F.concat(F.lit("again "), "text")).alias("text")
    )
    twice = again.where("source_name LIKE '%3'").withColumn("text", F.concat(F.lit("zz "), "text"))
    arrivals.add_documents(again.unionByName(twice), home, V.ENCODER, 0, sink="second", added_at=day(2))
    requests = docs.where("doc_id % 5 = 0").select(
        F.col("source_name").alias("name"), F.lit(day(3)).cast("timestamp_ntz").alias("requested_at"), F.col("doc_id").alias("seq")
    )
    arrivals.delete_documents(spark, home, requests, 0)
    return arrivals.load_chunks(spark, home).select("source_name", "chunk_id", "chunk")


@query
def screen_stream(spark, d):
    home = scale.scratch_path(spark, "screen")
    turns = _stream(spark, d, "conversations").where("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text"
    )
    arrivals.screen_stream(turns, f"{home}/log", f"{home}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{home}/log").select("query_id", "error", "channel", "is_url", "search_text")


# --- sinks read back ---------------------------------------------------------------------

@query
def registry_round_trip(spark, d):
    path = scale.scratch_path(spark, "registry")
    log = V.registry_log(spark, d)
    for i in range(2):
        arrivals.append_registry(log.where(F.col("seq") % 2 == i), path, i, sink=f"s{i}")
    return registry.listing(arrivals.load_registry(spark, path, tolerant=True))


@query
def report_round_trip(spark, d):
    path = scale.scratch_path(spark, "report")
    report = class_eval.summary(V.predictions(spark, d))
    corpus_source.write_csv(report, path)
    return spark.read.schema(report.schema).option("header", True).option("escape", '"').csv(path)


@query
def retrieval_report_round_trip(spark, d):
    path = scale.scratch_path(spark, "report")
    report = retrieval_benchmark(spark, d)
    corpus_source.write_csv(report, path)
    return spark.read.schema(report.schema).option("header", True).option("escape", '"').csv(path)


@query
def registry_compacted(spark, d):
    """Snapshots taken while operations arrive; covered log folders deleted."""
    path = scale.scratch_path(spark, "registry-store")
    log = V.registry_log(spark, d)
    for i in range(4):
        registry_store.append(log.where(F.col("seq") % 4 == i), path, i)
        if i in (1, 2):
            registry_store.compact(spark, path)
            registry_store.vacuum(spark, path)
    return registry.listing(registry_store.load(spark, path))


@query
def history_page(spark, d):
    """The newest 200 analyses, from the folders of the last days."""
    path = scale.scratch_path(spark, "history-days")
    log = V.analysis_log(spark, d)
    for i in range(2):
        arrivals.append_history_days(log.where(F.col("seq") % 2 == i), path, i)
    return arrivals.newest_history(spark, path, 200)


@query
def history_append(spark, d):
    path = scale.scratch_path(spark, "history")
    log = V.analysis_log(spark, d)
    for i in range(3):
        arrivals.append_history(log.where(F.col("seq") % 3 == i), path, i)
    return registry.history(arrivals.load_history(spark, path))


@query
def history_clear(spark, d):
    path = scale.scratch_path(spark, "history")
    log = V.analysis_log(spark, d)
    arrivals.append_history(log, path, 0)
    corpus_source.clear_history(spark, path, confirm=True)
    arrivals.append_history(log.where("label = 'phishing'"), path, 1)
    return registry.history(arrivals.load_history(spark, path))
