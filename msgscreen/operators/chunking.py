"""Documents from pages, and fixed-size chunks, without holding a document in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from msgscreen.functions.text import WHITESPACE, strip

# Chunk length in characters; chunks of at most MIN_CHARS are dropped.
CHUNK_CHARS = 500
MIN_CHARS = 50

#: Pages handled together by one row of a prefix sum.
PAGES_PER_BLOCK = 1024

# Fixed value: the only accepted suffix, compared with its case.
SUFFIX = ".pdf"


def accepted_names(docs: DataFrame, name: str = "name") -> DataFrame:
    """Add ``reject_reason``: ``no_name``, ``not_pdf`` or NULL when accepted."""
    value = F.coalesce(F.col(name), F.lit(""))
    return docs.withColumn(
        "reject_reason",
        F.when(value == "", "no_name").when(~F.endswith(value, F.lit(SUFFIX)), "not_pdf"),
    )


def chunk_array(text: Column, size: int = CHUNK_CHARS) -> Column:
    """Fixed-length slices of the stripped text, newlines turned into spaces."""
    flat = strip(F.replace(text, F.lit("\n"), F.lit(" ")))
    return F.regexp_extract_all(flat, F.lit("(?s).{1,%d}" % size), F.lit(0))


def chunk_documents(
    docs: DataFrame, name: str = "source_name", text: str = "text", size: int = CHUNK_CHARS
) -> DataFrame:
    """``(source_name, chunk_id, chunk)`` of whole documents; one linear pass per row, no shuffle."""
    return docs.select(
        F.col(name).alias("source_name"), F.posexplode(chunk_array(F.col(text), size)).alias("chunk_id", "chunk")
    ).where(F.length("chunk") > MIN_CHARS).withColumn("chunk_id", F.col("chunk_id").cast("bigint"))


def assemble_pages(pages: DataFrame) -> DataFrame:
    """``(name, n_pages, text)``: page texts in order, a newline after each; a NULL page counts as empty.

    One row per document, so a document must fit a row; ``chunk_pages`` chunks those that do not.
    """
    page = F.struct("page_no", F.coalesce("text", F.lit("")).alias("text"))
    return (
        pages.groupBy("name")
        .agg(F.sort_array(F.collect_list(page)).alias("_p"))
        .select(
            "name",
            F.size("_p").cast("bigint").alias("n_pages"),
            F.concat(F.array_join(F.col("_p.text"), "\n"), F.lit("\n")).alias("text"),
        )
    )


def chunk_pages(pages: DataFrame, size: int = CHUNK_CHARS, pages_per_block: int = PAGES_PER_BLOCK) -> DataFrame:
    """Chunks of page tables, equal to chunking the assembled document.

    Where a page starts inside its document comes from a two-level running sum (blocks,
    then pages in a block); each page is cut at the chunk borders it crosses and pieces
    meet per chunk. No step gathers more than a block of lengths or one chunk of text,
    also when one document holds a third of all pages.
    """
    flat = pages.select(
        "name",
        "page_no",
        F.floor(F.col("page_no") / pages_per_block).alias("block"),
        F.concat(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), F.lit(" ")).alias("piece"),
    )
    white = F.lit(WHITESPACE)
    lengths = flat.select(
        "name", "block", "page_no",
        F.length("piece").cast("bigint").alias("len"),
        (F.length("piece") - F.length(F.ltrim("piece", white))).alias("lead"),
        F.length(F.rtrim("piece", white)).alias("tail"),
    )
    in_block = (
        Window.partitionBy("name", "block").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = lengths.withColumn("inner", F.coalesce(F.sum("len").over(in_block), F.lit(0)))
    solid = F.col("tail") > 0
    # A block is one row: its length, and where its first and last visible characters stand in it.
    blocks = inside.groupBy("name", "block").agg(
        F.sum("len").alias("block_len"),
        F.min(F.when(solid, F.col("inner") + F.col("lead"))).alias("solid_from"),
        F.max(F.when(solid, F.col("inner") + F.col("tail"))).alias("solid_to"),
    )
    whole = Window.partitionBy("name")
    by_name = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("base", F.coalesce(F.sum("block_len").over(by_name), F.lit(0))).select(
        "name", "block", "base",
        F.min(F.col("base") + F.col("solid_from")).over(whole).alias("first"),
        F.max(F.col("base") + F.col("solid_to")).over(whole).alias("last"),
    )
    placed = (
        inside.join(blocks.where("first IS NOT NULL"), ["name", "block"])
        .withColumn("start", F.col("base") + F.col("inner"))
    )
    low = F.greatest("start", "first") - F.col("first")
    high = F.least(F.col("start") + F.col("len"), F.col("last")) - F.col("first")
    cuts = (
        placed.withColumn("lo", low)
        .withColumn("hi", high)
        .where("lo < hi")
        .join(flat.select("name", "block", "page_no", "piece"), ["name", "block", "page_no"])
    )
    chunk_no = F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor((F.col("hi") - 1) / size)))
    pieces = cuts.select("name", "page_no", "piece", "lo", "hi", "start", "first", chunk_no.alias("chunk_id"))
    begin = F.greatest(F.col("lo"), F.col("chunk_id") * size)
    end = F.least(F.col("hi"), (F.col("chunk_id") + 1) * size)
    part = F.substring(
        F.col("piece"), (begin + F.col("first") - F.col("start") + 1).cast("int"), (end - begin).cast("int")
    )
    return (
        pieces.select("name", "chunk_id", "page_no", part.alias("part"))
        .groupBy("name", "chunk_id")
        .agg(F.sort_array(F.collect_list(F.struct("page_no", "part"))).alias("_p"))
        .select(
            F.col("name").alias("source_name"),
            F.col("chunk_id").cast("bigint").alias("chunk_id"),
            F.array_join(F.col("_p.part"), "").alias("chunk"),
        )
        .where(F.length("chunk") > MIN_CHARS)
    )
