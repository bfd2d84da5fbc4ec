"""Text expressions: normalise, tokenise, validate, preview. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgscreen.functions.bind import bind

#: Every code point that Python counts as whitespace; all of them lie at or below U+3000.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

# The Unicode \s of the JVM lacks the four ASCII separators that Python includes.
_RUN = r"(?U)[\s\x1c-\x1f]+"


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode whitespace, in one linear pass."""
    return F.trim(text, F.lit(WHITESPACE))


def squeeze(text: Column) -> Column:
    """Every run of whitespace becomes one space."""
    return F.regexp_replace(text, _RUN, " ")


def normalise(text: Column) -> Column:
    """Lower-case, collapse whitespace, strip. Punctuation and digits stay."""
    return F.trim(squeeze(F.lower(text)))


def tokens(text: Column) -> Column:
    """Whitespace tokens in order, without empty ones."""
    return F.array_remove(F.split(text, _RUN), "")


def split_tokens(column):
    """Arrow strings -> number of tokens of each, and all their tokens dictionary-encoded: ``tokens`` inside Arrow tasks."""
    from itertools import chain

    import numpy as np
    import pyarrow as pa

    words = [(value or b"").decode("utf-8", "replace").split() for value in column.cast(pa.binary()).to_pylist()]
    return np.fromiter(map(len, words), "int64", len(words)), pa.array(list(chain.from_iterable(words)), pa.string()).dictionary_encode()


def term_counts(tokens_: Column) -> Column:
    """``array<struct<term, tf>>`` of one row: sort the tokens, cut at the runs.

    Stays inside the row, so counting terms of whole documents needs no shuffle.
    """

    def cut(ordered: Column) -> Column:
        starts = F.array_compact(
            F.transform(
                ordered,
                lambda term, i: F.when((i == 0) | (term != F.coalesce(F.get(ordered, i - 1), F.lit(""))), i),
            )
        )
        return bind(starts, lambda s: F.transform(s, lambda at, j: run(ordered, s, at, j)))

    def run(ordered: Column, starts: Column, at: Column, j: Column) -> Column:
        end = F.coalesce(F.get(starts, j + 1), F.size(ordered))
        return F.struct(F.get(ordered, at).alias("term"), (end - at).cast("int").alias("tf"))

    return bind(F.sort_array(tokens_), cut)


def validation_error(text: Column, min_length: int = 5) -> Column:
    """``'empty'``, ``'too_short'`` or NULL for an acceptable message."""
    size = F.length(strip(F.coalesce(text, F.lit(""))))
    return F.when(size == 0, F.lit("empty")).when(size < min_length, F.lit("too_short"))


def validate_messages(df: DataFrame, text: str = "text") -> DataFrame:
    """Strip the message and add ``error``; callers split on ``error IS NULL``."""
    return df.withColumn("error", validation_error(F.col(text))).withColumn(text, strip(F.col(text)))


def preview(text: Column, width: int) -> Column:
    """First ``width`` characters, with ``...`` when something was cut."""
    return F.concat(
        F.left(text, F.lit(width)), F.when(F.length(text) > width, F.lit("...")).otherwise(F.lit(""))
    )
