"""Steps of a run leave no files behind that no later step reads."""

import os
import random
import time

from pyspark.sql import functions as F

from msgscreen.llm import bottomk
from msgscreen.llm.common import FREE_SHUFFLES, Tables
from msgscreen.scale import shared_dir


def _folders(top):
    return {d for d, _, names in os.walk(top.removeprefix("file://")) if any(x.startswith("part-") for x in names)}


def _names(folders):
    return sorted(os.path.basename(d).rsplit("-", 1)[0] for d in folders)


def _shuffles(spark):
    tops = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {x for top in tops for _, _, names in os.walk(top.getPath()) for x in names if x.startswith("shuffle_") and x.endswith(".data")}


def test_near_duplicates_leave_only_what_their_rows_read(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    made = [(i, " ".join(words[:k] + [f"x{i}"] + words[k + 1 :])) for i, k in enumerate(rng.choices(range(150), k=40))]
    had = _folders(shared_dir(spark))
    got = bottomk.linked(spark.createDataFrame(made, "doc_id bigint, text string"))
    assert _names(_folders(shared_dir(spark)) - had) == ["label", "sketches"]
    assert len(got.collect()) == len(made)


def test_tables_replace_each_other_and_free_their_shuffles(spark):
    tables, had = Tables(spark, "test"), _shuffles(spark)
    table = tables.put("sums", spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s")))
    table = tables.put("sums", table.groupBy((F.col("k") % 2).alias("k")).agg(F.sum("s").alias("s")))
    assert dict(table.collect()) == {k: sum(i for i in range(1000) if i % 7 % 2 == k) for k in (0, 1)}
    assert _names(_folders(tables.folder)) == ["sums"] and spark.conf.get(FREE_SHUFFLES) == "false"
    until = time.time() + 20
    while _shuffles(spark) - had and time.time() < until:  # freed beside the next work
        time.sleep(0.2)
    assert not _shuffles(spark) - had
