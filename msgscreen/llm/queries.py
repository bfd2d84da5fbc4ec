"""One registered query for each operator: the thin digest over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from msgscreen.llm import (
    bottomk, decontaminate, language_id, ngram_lm, packing, periodic, pivots, prefix_trie, secrets, simhash_bk, suffix_dedup, toxicity, url_rules,
)
from msgscreen.llm.common import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.ToxicityModel:
    """Fitted on the labelled rows whose fold is not 0."""
    learnt = fold(F.col("doc_id"), 5) != 0
    return toxicity.fit(docs.where(learnt), table(spark, sf_dir, "labels").where(learnt))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.scored(docs, toxicity_model(spark, sf_dir, docs))
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = language_id.fit(docs.where(~held_out))
    found = language_id.identified(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score")
    )


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.col("hits.n_words").alias("n_words"), F.col("hits.n_hit").alias("n_hit"),
        F.size("hits.item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hits.item_ids", ","), 256).alias("items_sha256"), (F.col("hits.n_hit") > 0).alias("contaminated"),
    )


@query
def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_rules.judged(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", *[F.col(f"judged.{c}").alias(c) for c in ("host", "path", "rule", "verdict")])


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("secrets.base")
    count = [F.size(F.filter(base, lambda s, k=k: s["kind"] == k)).cast("bigint").alias(f"n_{secrets.KINDS[k]}") for k in range(3)]
    return found.select(
        "doc_id", *count, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("secrets.spans")).alias("spans")
    )


@query
def op10_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = pivots.usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    vectors = vectors.select("vec_id", pivots.scaled(F.col("v")).alias("v"))
    return pivots.topk(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


@query
def op6_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.linked(table(spark, sf_dir, "documents"))


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op7_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = ngram_lm.scored(docs, fold(F.col("doc_id"), 7) != 2)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def id_hash(key: Column) -> Column:
    """Unsigned crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the texts get a periodic tail first, as the contract of the query says."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = id_hash(F.col("doc_id"))
    docs = docs.withColumn("words", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))))
    g, n = F.floor(h / 10), F.size("words").cast("bigint")
    docs = docs.select("doc_id", "text", "words", n.alias("n"), (g % n).alias("a"), (3 + g % 8).alias("parts"))
    tail = F.col("n") - F.col("a")
    period = (1 + F.floor(tail / F.col("parts"))).cast("int")
    block = F.slice("words", (F.col("a") + 1).cast("int"), period)
    repeated = F.slice(F.flatten(F.array_repeat(block, F.ceil(tail / period).cast("int"))), F.lit(1), tail.cast("int"))
    tailed = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), repeated), " ")
    docs = docs.select("doc_id", F.when(F.col("n") > 0, tailed).otherwise(F.col("text")).alias("text"))
    found = periodic.with_runs(docs)
    runs = F.col("periodic.runs")
    ratio = lambda x, y: x["length"] * y["period"] - y["length"] * x["period"]
    order = lambda x, y: F.when(ratio(x, y) != 0, F.signum(ratio(y, x))).otherwise(
        F.signum(F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["period"] - y["period"]))
    ).cast("int")
    listed = F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = F.get(F.array_sort(runs, order), F.lit(0))
    return found.select(
        "doc_id", F.size(runs).cast("bigint").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2(F.col("periodic.collapsed"), 256).alias("collapsed_sha256"),
    )


@query
def op13_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bk.linked(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations borrow the first turns of the one whose id ends in 00 first, as the contract of the query says."""
    turns, parts = prefix_trie.numbered(table(spark, sf_dir, "conversations"))
    number = (F.col("place") - F.col("first") + F.col("before")).alias("number")
    heads = (
        turns.where(F.col("conv_id") % 100 == 0).join(parts, ["conv_id", "part"]).select("conv_id", number, "digest", "size").where("number < 5")
        .groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("number", "digest", "size"))).alias("head"))
    )
    convs = parts.select("conv_id").distinct().withColumn("h", (id_hash(F.col("conv_id")) % 6).cast("int"))
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).join(heads, "base", "left")
    convs = convs.select("conv_id", "h", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h")).alias("head"))
    borrowed = convs.select("conv_id", F.inline("head")).select("conv_id", (F.col("number") + 1).alias("depth"), "digest", "size")
    shift = convs.select("conv_id", "h", F.size("head").alias("taken"))
    own = turns.join(parts.join(shift, "conv_id"), ["conv_id", "part"]).where(number >= F.col("h"))
    own = own.select("conv_id", (number - F.col("h") + F.col("taken") + 1).alias("depth"), "digest", "size")
    return prefix_trie.trie(borrowed.unionAll(own), convs).withColumnRenamed("saved", "saved_tokens")
