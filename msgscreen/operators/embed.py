"""Text to vectors: a built-in hashing encoder and a plug point for the user's own model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from msgscreen.functions.text import split_tokens, tokens
from msgscreen.schema import VECTOR


class Encoder(Protocol):
    """Adds a column of unit vectors to a table.

    ``keep`` names the columns that stay (all by default); leaving out the text spares
    its way through the Python worker.
    """

    def encode(
        self, df: DataFrame, text: str, out: str = "embedding", keep: Sequence[str] | None = None
    ) -> DataFrame: ...


def _schema_with(df: DataFrame, keep: Sequence[str], out: str) -> T.StructType:
    return T.StructType([*[df.schema[name] for name in keep], T.StructField(out, VECTOR, True)])


@dataclass(frozen=True)
class HashingEncoder:
    """Term counts hashed into ``dim`` buckets, L2-normalised.

    A stand-in with no semantics. One ``bincount`` per block of rows counts the buckets in Python. No shuffle.
    ``md5`` buckets can be reproduced by any engine; a token is hashed once for each Arrow batch it occurs in.
    ``xxhash64`` runs in the JVM, token by token.
    """

    dim: int = 64
    hash: str = "xxhash64"

    def buckets(self, text: Column) -> Column:
        if self.hash == "md5":
            return F.transform(
                tokens(text),
                lambda t: (F.conv(F.left(F.md5(t), F.lit(8)), 16, 10).cast("bigint") % self.dim).cast("int"),
            )
        if self.hash == "xxhash64":
            return F.transform(tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(self.dim)).cast("int"))
        raise ValueError(f"unknown hash {self.hash!r}")

    def encode(
        self, df: DataFrame, text: str, out: str = "embedding", keep: Sequence[str] | None = None
    ) -> DataFrame:
        keep, dim, words = list(df.columns if keep is None else keep), self.dim, self.hash == "md5"
        value = F.coalesce(F.col(text), F.lit(""))
        hashed = df.select(*keep, (value if words else self.buckets(value)).alias(out))

        def bucket_lists(column):
            """Texts -> lists of buckets, as ``buckets`` has them."""
            import hashlib

            import numpy as np
            import pyarrow as pa

            sizes, coded = split_tokens(column)
            digests = (hashlib.md5(word.encode(), usedforsecurity=False).digest() for word in coded.dictionary.to_pylist())
            of = np.array([int.from_bytes(digest[:4], "big") % dim for digest in digests], "int32")
            return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(of[coded.indices.to_numpy()], pa.int32()))

        def unit_counts(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                if words:
                    batch = batch.set_column(batch.schema.get_field_index(out), out, bucket_lists(batch[out]))
                # Blocks bound the counting matrix whatever the dimension.
                for at in range(0, batch.num_rows, 4096):
                    block = batch.slice(at, 4096)
                    n, buckets = block.num_rows, block[out]
                    sizes = buckets.value_lengths().to_numpy(zero_copy_only=False)
                    flat = buckets.flatten().to_numpy(zero_copy_only=False)
                    rows = np.repeat(np.arange(n, dtype="int64"), sizes)
                    m = np.bincount(rows * dim + flat, minlength=n * dim).reshape(n, dim).astype("float64")
                    norm = np.sqrt((m * m).sum(axis=1))
                    norm[norm == 0] = 1.0
                    unit = (m / norm[:, None]).astype("float32")
                    vectors = pa.ListArray.from_arrays(
                        pa.array(np.arange(n + 1, dtype="int32") * dim), pa.array(unit.ravel())
                    )
                    yield pa.RecordBatch.from_arrays([*[block[c] for c in keep], vectors], [*keep, out])

        return hashed.mapInArrow(unit_counts, _schema_with(df, keep, out))


@dataclass(frozen=True)
class BatchEncoder:
    """The user's model: ``load()`` returns ``encode(list of texts) -> 2-D array``.

    The model is loaded once per Python task process and fed ``batch`` texts at a time.
    """

    load: Callable[[], Callable[[Sequence[str]], object]]
    batch: int = 64
    normalise: bool = True

    def encode(
        self, df: DataFrame, text: str, out: str = "embedding", keep: Sequence[str] | None = None
    ) -> DataFrame:
        load, size, unit = self.load, self.batch, self.normalise
        keep = list(df.columns if keep is None else keep)

        def run(frames: Iterator) -> Iterator:
            import numpy as np

            model = load()
            for frame in frames:
                vectors = []
                for at in range(0, len(frame), size):
                    part = np.asarray(model(frame[text].iloc[at : at + size].tolist()), dtype="float32")
                    if unit:
                        norm = np.sqrt((part.astype("float64") ** 2).sum(axis=1, keepdims=True))
                        part = (part / np.where(norm == 0, 1.0, norm)).astype("float32")
                    vectors.extend(part)
                kept = frame[keep].copy()
                kept[out] = vectors
                yield kept

        return df.mapInPandas(run, _schema_with(df, keep, out))


def embed(
    df: DataFrame, encoder: Encoder, text: str = "text", out: str = "embedding", keep: Sequence[str] | None = None
) -> DataFrame:
    return encoder.encode(df, text, out, keep)
