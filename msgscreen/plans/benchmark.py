"""Benchmark of encoders on a labelled corpus: quality metrics plus timings of the jobs."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgscreen.functions.text import normalise
from msgscreen.operators.embed import Encoder
from msgscreen.operators.sampling import SEED, simple_sample
from msgscreen.operators.dense import index_size_mb
from msgscreen.operators.retrieval_eval import mean_metrics, query_metrics
from msgscreen.plans.retrieve import FINAL, SAMPLE, knn_leave_one_out
from msgscreen.scale import stored
from msgscreen.sources.corpus import write_csv


def benchmark_encoders(
    corpus: DataFrame,
    encoders: dict[str, Encoder],
    *,
    text: str = "text",
    k: int = FINAL,
    sample_size: int = SAMPLE,
    seed: int = SEED,
    output_csv: str | None = None,
) -> DataFrame:
    """Encode ``(doc_id, text, label)`` with every encoder, search a sample, report one row each.

    An encoder that fails to load (on the first text) keeps a row with its ``error`` and NULL figures;
    any later failure fails the job. Vectors are written once per encoder. One search run gives both
    the time (wall time of the sample, its encoding included, divided by its size) and the metrics.
    """
    spark = corpus.sparkSession
    drawn = stored(simple_sample(corpus.select("doc_id", text, "label"), sample_size, "doc_id", seed), "sample")
    asked_rows = drawn.count()
    labels = corpus.select("doc_id", "label")
    timings, metrics, sizes = [], [], []
    for name, encoder in encoders.items():
        start = time.perf_counter()
        try:
            encoder.encode(drawn.limit(1).select("doc_id", text), text, keep=["doc_id"]).collect()
        except Exception as error:
            timings.append((name, None, None, None, str(error).strip().splitlines()[-1][:200]))
            continue
        loaded = time.perf_counter() - start
        start = time.perf_counter()
        vectors = stored(encoder.encode(corpus.select("doc_id", text), text, keep=["doc_id"]), "vectors")
        encoded = time.perf_counter() - start
        queries = drawn.select(F.col("doc_id").alias("query_id"), normalise(F.col(text)).alias("text"))
        start = time.perf_counter()
        run = stored(knn_leave_one_out(encoder.encode(queries, "text", keep=["query_id"]), vectors, k), "run")
        searched = time.perf_counter() - start
        per_query = query_metrics(
            run, drawn.select(F.col("doc_id").alias("query_id"), "label"), labels, k, row_bound=sample_size * k
        )
        metrics.append(per_query.withColumn("model", F.lit(name)))
        sizes.append(index_size_mb(vectors).withColumn("model", F.lit(name)))
        timings.append((name, round(loaded, 2), round(encoded, 2), round(1000 * searched / max(1, asked_rows), 3), None))
    kinds = "model string, load_time_s double, encoding_time_s double, avg_search_time_ms double, error string"
    result = spark.createDataFrame(timings, kinds)
    if metrics:
        means = mean_metrics(reduce(DataFrame.unionByName, metrics))
        result = result.join(reduce(DataFrame.unionByName, sizes), "model", "left").join(means, "model", "left")
    if output_csv:
        write_csv(result, output_csv)
    return result
