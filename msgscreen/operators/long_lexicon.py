"""Word lists too long for an expression a word: which entries of a lexicon occur in which texts.

An entry is filed under the rarest of its q-grams (rare among the entries); a text meets only the entries filed under
one of its own q-grams, and each of those is looked for in the text. Entries shorter than a q-gram are filed under themselves, and texts are
also cut into all shorter pieces. Texts and entries are lower-cased as ``lexicon_hits`` does. Nothing in the plan
grows with the list but the table of entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from msgscreen.scale import BROADCAST_BYTES, measured_bytes

#: Characters of a q-gram.
Q = 3


def _cut(text: Column, size: int) -> Column:
    """All pieces of ``size`` characters; of a shorter text, the text."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1)))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))


def _grams(text: Column, q: int) -> Column:
    """All distinct pieces of up to ``q`` characters that an entry may be filed under."""
    return F.array_distinct(F.concat(*[_cut(text, size) for size in range(1, q + 1)]))


def filed(lexicon: DataFrame, q: int = Q) -> DataFrame:
    """``(word, pos, gram)`` for ``lexicon(pos, word)``: each entry under its rarest q-gram; empty words match every text."""
    entries = lexicon.select("pos", "word").where("word IS NOT NULL AND word <> ''")
    long = F.length("word") >= q
    grams = F.when(long, F.array_distinct(_cut(F.col("word"), q))).otherwise(F.array("word"))
    each = entries.select("pos", "word", F.explode(grams).alias("gram"))
    rare = each.groupBy("gram").agg(F.count("*").alias("n"))
    order = Window.partitionBy("pos", "word").orderBy("n", "gram")  # as many rows as an entry has q-grams
    return each.join(rare, "gram").withColumn("_r", F.row_number().over(order)).where("_r = 1").select("word", "pos", "gram")


def long_lexicon_hits(texts: DataFrame, lexicon: DataFrame, text: str = "text", keys: list[str] | None = None, q: int = Q) -> DataFrame:
    """``(*keys, pos, word)``: every entry of ``lexicon(pos, word)`` that the lower-cased text contains, once for each ``pos``.

    ``keys`` name a row (all columns but the text, by default). Entries are compared as they are, like ``lexicon_hits``.
    """
    keys = [c for c in texts.columns if c != text] if keys is None else keys
    entries = filed(lexicon, q)
    small = measured_bytes(entries) <= BROADCAST_BYTES
    low = texts.select(*keys, F.lower(text).alias("_t")).where("_t IS NOT NULL")
    met = low.select(*keys, "_t", F.explode(_grams(F.col("_t"), q)).alias("gram")).join(F.broadcast(entries) if small else entries, "gram")
    hits = met.where(F.contains("_t", "word")).select(*keys, "pos", "word")
    blank = lexicon.where("word = ''").select("pos", "word")
    if blank.isEmpty():
        return hits
    # Empty entries are in every text: each entry is a column of its own, so no row of texts is sent anywhere.
    entries = F.array(*[F.struct(F.lit(r["pos"]).alias("pos"), F.lit("").alias("word")) for r in blank.collect()])
    return hits.unionByName(low.select(*keys, F.inline(entries)))
