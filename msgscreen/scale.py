"""Size checks and shared-folder rules used by every operator.

Nothing here decides on a guess: a side is broadcast only after its bytes were
summed on the cluster, and intermediate tables go to the folder that the
session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest side, in bytes of plain values, that may be copied to every executor.
BROADCAST_BYTES = 32 << 20


def _width(field: T.StructField) -> Column:
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        width = F.octet_length(value) + 16
    elif isinstance(field.dataType, T.ArrayType) and isinstance(
        field.dataType.elementType, (T.StringType, T.StructType, T.ArrayType)
    ):
        width = F.octet_length(F.to_json(F.struct(value))) + 16
    elif isinstance(field.dataType, T.ArrayType):
        width = F.size(value) * 8 + 16
    else:
        width = F.lit(8)
    return F.coalesce(width.cast("long"), F.lit(8).cast("long"))


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of plain values in ``df``, summed on the cluster (one row comes back)."""
    row_width = reduce(add, [_width(f) for f in df.schema.fields])
    row = df.agg(F.count("*"), F.sum(row_width)).first()
    return int(row[0]), int(row[1] or 0)


def measured_bytes(df: DataFrame) -> int:
    return measured(df)[1]


def broadcast_bounded(df: DataFrame, row_bound: int, row_bytes: int = 64) -> DataFrame:
    """Broadcast ``df`` when its size is proven by ``row_bound``, without running it.

    A ranked list of k rows per query holds at most ``queries * k`` rows, so the
    query count alone proves the bound.
    """
    return F.broadcast(df) if row_bound * row_bytes <= BROADCAST_BYTES else df


_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors see.

    Where it is unset, a session in one process (tests) gets a fresh folder; on a cluster that
    would be a disk of its own for every machine, so the setting is demanded.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="msgscreen-")
    return _OWN_DIRS[app]


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark)}/msgscreen/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, however often it is used."""
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that is no longer needed."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path))


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is absent."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(jvm_path)] if files.exists(jvm_path) else []


#: Tasks whose best rows meet in one step of ``merged_best``.
FAN_IN = 64
#: Bytes of queries that one block of a blocked plan sends past a fragment.
QUERY_BLOCK_BYTES = 32 << 20


def block_count(query_bytes: int) -> int:
    return max(1, -(-query_bytes // QUERY_BLOCK_BYTES))


def block_pairs(queries: DataFrame, corpus: DataFrame, fragments: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Number both sides by ``frag`` so that a task meets one fragment of the corpus with one block of queries.

    Queries go to each fragment under their own block, fragments to each block.
    """
    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    q = queries.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("frag", every(fragments))
    c = corpus.withColumn("frag", F.pmod(F.xxhash64("doc_id"), F.lit(fragments)).cast("int")).withColumn("_b", every(blocks))
    number = (F.col("frag") * blocks + F.col("_b")).cast("int")
    return q.withColumn("frag", number).drop("_b"), c.withColumn("frag", number).drop("_b")


def merged_best(partial: DataFrame, k: int, tasks: int) -> DataFrame:
    """Best k ``(query_id, doc_id, rank, score)`` of what ``tasks`` tasks found.

    With many tasks their rows meet in groups of ``FAN_IN`` first, so that no shuffle gathers
    queries x k x tasks rows by query alone.
    """
    order = [F.desc("score"), F.asc("doc_id")]
    if tasks > FAN_IN:
        grouped = partial.withColumn("_g", F.floor(F.spark_partition_id() / FAN_IN))
        partial = top_rows(grouped, ["query_id", "_g"], order, k).drop("_g", "rank")
    return top_rows(partial, ["query_id"], order, k).select("query_id", "doc_id", "rank", "score")


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of every key group, ranked from 1.

    Spark turns the filter on ``row_number`` into a group limit that runs before
    the shuffle, so a group that holds a third of all rows sends ``k`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
