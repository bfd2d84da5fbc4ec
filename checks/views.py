"""Stand-ins for the data model, derived from the test tables on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgscreen.operators import pruned
from msgscreen.operators.embed import HashingEncoder
from msgscreen.operators.lexical import build_lexical_index
from msgscreen.scale import remove, scratch_path, shared_dir
from msgscreen.sources import segments
from msgscreen.sources.index import build_retrieval_system, load_cases, save_cases
from msgscreen.streaming import arrivals

#: Buckets by md5, so that SQL can form the same vectors.
ENCODER = HashingEncoder(dim=64, hash="md5")
MODELS = ["model_a", "model_b", "model_c"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "conversations")
        .where("role = 'user'")
        .select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("quality") == 0, "phishing").when(F.col("quality") == 1, "legitimate")
    risk = F.when(F.col("quality") == 0, "critical").when(F.col("quality") == 1, "low")
    attack = F.when(F.col("toxic") == 1, "threat").when(F.col("toxic") == 0, "none")
    return (
        spark.read.parquet(f"{sf_dir}/documents.parquet")
        .join(table(spark, sf_dir, "labels"), "doc_id", "left")
        .select(
            "doc_id", "text", label.alias("label"), F.col("lang").alias("language"),
            attack.alias("attack_type"), risk.alias("risk_level"), F.col("source").alias("channel"),
        )
    )


def labelled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus without its texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    label = F.when(F.col("quality") == 0, "phishing").when(F.col("quality") == 1, "legitimate")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").select(
        "doc_id", label.alias("label"), F.col("lang").alias("language")
    )


def labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), "embedding", F.col("label").cast("string").alias("label")
    )


_SYSTEMS: dict = {}


def index_home(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/msgscreen/{spark.sparkContext.applicationId}/index"


def retrieval_system(spark: SparkSession, sf_dir: str):
    """Stored index of the documents: built on first use, then handed out again."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SYSTEMS:
        _SYSTEMS[key] = build_retrieval_system(
            documents(spark, sf_dir), index_home(spark), ENCODER, encoder_name="md5_64"
        )
    return _SYSTEMS[key]


_BLOCKS: dict = {}


def block_index(spark: SparkSession, sf_dir: str) -> pruned.BlockIndex:
    """A stored index in blocks, built on first use."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BLOCKS:
        path = scratch_path(spark, "blocks")
        pruned.save_blocks(build_lexical_index(documents(spark, sf_dir)), path)
        _BLOCKS[key] = pruned.load_blocks(spark, path)
    return _BLOCKS[key]


def cell_store(spark: SparkSession, sf_dir: str) -> pruned.BoundedCells:
    """Vectors stored by cell with the bounds of each cell, placed on first use."""
    key = (spark.sparkContext.applicationId, sf_dir, "cells")
    if key not in _BLOCKS:
        path = scratch_path(spark, "cells")
        pruned.save_cells(labelled_vectors(spark, sf_dir).select("doc_id", "embedding"), path)
        _BLOCKS[key] = pruned.load_cells(spark, path)
    return _BLOCKS[key]


#: Folders of the case table.
CASE_PARTS = 64


def case_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as a stored case table, written on first use."""
    key = (spark.sparkContext.applicationId, sf_dir, "cases")
    if key not in _BLOCKS:
        path = scratch_path(spark, "case-table")
        save_cases(corpus(spark, sf_dir), path, CASE_PARTS)
        _BLOCKS[key] = load_cases(spark, path)
    return _BLOCKS[key]


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages to screen: every benchmark text, and a link for each."""
    asked = queries(spark, sf_dir)
    number = F.col("query_id").cast("string")
    link = F.concat(F.lit("http://secure-"), number, F.lit(".paypal.verify-account.tk/login?won="), number)
    return asked.unionByName(asked.select((F.col("query_id") + 1_000_000_000).alias("query_id"), link.alias("text")))


def knowledge_base(spark: SparkSession, sf_dir: str) -> str:
    """Folder of a stored knowledge base: the documents as two batches, chunked, encoded and filed under cells, on first use."""
    key = (spark.sparkContext.applicationId, sf_dir, "kb")
    if key not in _BLOCKS:
        path = scratch_path(spark, "knowledge")
        docs = documents(spark, sf_dir).select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("source_name"), "text", "doc_id")
        arrivals.add_documents(docs.where("doc_id % 2 = 0").drop("doc_id"), path, ENCODER, 0)
        arrivals.fit_chunk_cells(spark, path, 16)
        arrivals.add_documents(docs.where("doc_id % 2 <> 0").drop("doc_id"), path, ENCODER, 1)
        _BLOCKS[key] = path
    return _BLOCKS[key]


_STORES: dict = {}


def changed_store(spark: SparkSession, sf_dir: str, postings: bool = False) -> str:
    """Index store of a folder whose files came, changed and went until it held the documents, no more.

    At first a quarter of the documents is missing, a quarter has other texts, and files and rows of copies
    are there that go later, as whole files or by their ids.
    """
    key = (spark.sparkContext.applicationId, sf_dir, postings)
    if key in _STORES:
        return _STORES[key]
    docs, home = documents(spark, sf_dir), scratch_path(spark, "changing")
    folder, store = f"{home}/files", f"{home}/store"
    quarter = lambda n: docs.where(F.pmod("doc_id", F.lit(4)) == n)

    def put(rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={name}")

    def refresh() -> None:
        corpus = spark.read.schema("doc_id bigint, text string, batch string").parquet(folder)
        segments.refresh(corpus, folder, store, postings=postings)

    copies = docs.where("doc_id % 20 = 2").withColumn("doc_id", F.col("doc_id") + 1_000_000_000)
    put(quarter(0), "0")
    put(quarter(1).withColumn("text", F.concat(F.lit("an older wording of "), F.left("text", F.lit(200)))), "1")
    put(quarter(2).unionByName(copies), "2")
    put(copies.withColumn("doc_id", F.col("doc_id") + 1_000_000_000), "9")
    refresh()
    put(quarter(1), "1")
    put(quarter(3), "3")
    remove(spark, f"{folder}/batch=9")
    refresh()
    segments.remove_documents(spark, store, copies)
    _STORES[key] = store
    return store


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page URL and variants of it that carry the signals the features look for."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.col("page_id").cast("string")
    variants = [
        F.col("url"),
        F.regexp_replace("url", r"\.example\.[a-z]+", "-secure-login.xyz"),
        F.regexp_replace("url", "^https?://", "www."),
        F.regexp_replace("url", "^https?://", "HTTPS://User@"),
        F.regexp_replace("url", r"\.example\.[a-z]+", ".paypal.verify-account.tk:8080"),
        F.concat(F.lit("http://192.168."), (F.col("page_id") % 300).cast("string"), F.lit(".1/login;v="), number),
        F.concat(F.lit("https://example.org/a;x=1/b;y="), number, F.lit("?urgent-verification#won")),
        F.concat(F.lit("host-"), number, F.lit(".live/free/prize")),
    ]
    numbered = [F.struct(F.lit(i).cast("bigint").alias("variant"), v.alias("url")) for i, v in enumerate(variants)]
    return pages.select("page_id", F.inline(F.array(*numbered)))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = labelled_ids(spark, sf_dir).where("label IS NOT NULL")
    digest = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("model")))
    first = F.left(digest, F.lit(1))
    other = F.when(F.col("label") == "phishing", "legitimate").otherwise("phishing")
    return labelled.withColumn("model", F.explode(F.array(*[F.lit(m) for m in MODELS]))).select(
        "doc_id",
        "model",
        F.col("label").alias("true_label"),
        F.when(first == "0", "error").when(first == "1", "unknown").when(first >= "9", other)
        .otherwise(F.col("label")).alias("pred_label"),
        (F.conv(F.substring(digest, 2, 2), 16, 10).cast("int") / 100.0).alias("response_time"),
        "language",
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model answers, one per document, in every shape that models produce."""
    rows = labelled_ids(spark, sf_dir).select("doc_id", F.coalesce("label", F.lit("unsure")).alias("label"), "language")
    number = F.col("doc_id").cast("string")
    digit = F.left(F.md5(F.concat(number, F.lit(":r"))), F.lit(1))
    plain = F.concat(
        F.lit('{"label":"'), F.col("label"), F.lit('","confidence":0.'),
        F.lpad((F.col("doc_id") * 5 % 1000).cast("string"), 3, "0"),
        F.lit(',"risk_score":'), (F.col("doc_id") % 101).cast("string"),
        F.lit(',"language":"'), F.col("language"),
        F.lit('","attack_type":"none","explanation":"case '), number,
        F.lit('","suspicious_elements":["e'), number, F.lit('","x"],"recommendation":"wait"}'),
    )
    raw = (
        F.when(digit == "0", F.lit(None).cast("string"))
        .when(digit == "1", F.lit(""))
        .when(digit == "2", F.concat(F.lit("no json here "), number))
        .when(digit == "3", F.lit(
            '<think>{"label":"x"}</think>\n```json\n{"label":"Phishing","confidence":"high","risk_score":85}\n```'))
        .when(digit == "4", F.lit('Sure: {"label":"legit","confidence":1.7,"risk_score":"12"} ok'))
        .when(digit == "5", F.lit('{"confidence":0.29,"risk_score":"75.9"}'))
        .when(digit == "6", F.lit('{"label":"phishing","confidence":"0.8","risk_score":40.9}'))
        .when(digit == "7", F.lit('{"label":"phishing","confidence": }'))
        .when(digit == "8", F.lit('{"label":"\'legitimate\'","confidence":true,"risk_score":null}'))
        .otherwise(plain)
    )
    seconds = (F.col("doc_id") % 100) / 100.0
    return rows.select(
        F.col("doc_id").alias("query_id"), F.lit("model_a").alias("model"), raw.alias("raw"), seconds.alias("seconds")
    )


def registry_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("doc"), F.col("user_id").cast("string"), F.lit(".pdf"))
    return table(spark, sf_dir, "events").select(
        name.alias("name"),
        F.floor("value").alias("pages"),
        F.col("ts").alias("added_at"),
        F.concat(F.lit("uploads/"), name).alias("path"),
        F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"),
        F.col("event_id").alias("seq"),
    )


def analysis_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages stamped with the times of the event stream."""
    risky = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        "ts",
        F.col("event_id").alias("seq"),
        F.repeat(F.concat(F.col("props"), F.lit(" ")), (F.col("event_id") % 12).cast("int")).alias("text"),
        F.when(risky, "phishing").otherwise("legitimate").alias("label"),
        F.when(risky, "critical").otherwise("low").alias("risk_level"),
    )


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents: one turn per page."""
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv"), F.col("conv_id").cast("string"), F.lit(".pdf")).alias("name"),
        F.col("turn").alias("page_no"),
        "text",
    )


def host_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as pages of one document per top-level domain: few, long documents."""
    name = F.concat(F.regexp_extract("url", r"^[a-z]+://[^/:?#]*\.([a-z]+)", 1), F.lit(".pdf"))
    return table(spark, sf_dir, "pages").select(name.alias("name"), F.col("page_id").alias("page_no"), F.col("html").alias("text"))
