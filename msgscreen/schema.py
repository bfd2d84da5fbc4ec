"""Explicit schemas for every table the library reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


VECTOR = T.ArrayType(T.FloatType())

CORPUS = _struct(
    doc_id=T.LongType(), text=T.StringType(), norm_text=T.StringType(), label=T.StringType(),
    language=T.StringType(), attack_type=T.StringType(), risk_level=T.StringType(),
    channel=T.StringType(),
)

DOC_TERMS = T.StructType([
    T.StructField("doc_id", T.LongType(), True),
    T.StructField("dl", T.IntegerType(), True),
    T.StructField("terms", T.ArrayType(_struct(term=T.StringType(), tf=T.IntegerType())), True),
])
POSTINGS = _struct(term=T.StringType(), doc_id=T.LongType(), tf=T.IntegerType(), dl=T.IntegerType())
#: Stored postings: those of a term in neighbouring documents are one row.
POSTING_BLOCKS = _struct(
    term=T.StringType(), first=T.LongType(), n=T.IntegerType(),
    ids=T.ArrayType(T.LongType()), tfs=T.ArrayType(T.IntegerType()), dls=T.ArrayType(T.IntegerType()),
)
TERM_STATS = _struct(term=T.StringType(), df=T.LongType(), idf=T.DoubleType())
CORPUS_STATS = _struct(n=T.LongType(), avgdl=T.DoubleType(), avg_idf=T.DoubleType())
VECTORS = _struct(doc_id=T.LongType(), embedding=VECTOR)

DOC_PAGES = _struct(name=T.StringType(), page_no=T.LongType(), text=T.StringType())

#: ``sink`` and ``version`` name the stream and batch that wrote a row; they are folders.
KB_CHUNKS = _struct(
    source_name=T.StringType(), chunk_id=T.LongType(), chunk=T.StringType(), embedding=VECTOR,
    sink=T.StringType(), version=T.LongType(),
)
#: One row per document and version, also for documents without a chunk.
KB_DOCUMENTS = _struct(
    source_name=T.StringType(), chunks=T.LongType(), added_at=T.TimestampNTZType(), sink=T.StringType(), version=T.LongType(),
)

REGISTRY_LOG = _struct(
    name=T.StringType(), pages=T.LongType(), added_at=T.TimestampNTZType(), path=T.StringType(),
    op=T.StringType(), seq=T.LongType(),
)

ANALYSIS_LOG = _struct(
    ts=T.TimestampNTZType(), seq=T.LongType(), text=T.StringType(), label=T.StringType(),
    risk_level=T.StringType(), sink=T.StringType(), version=T.LongType(),
)

RESPONSES = _struct(
    query_id=T.LongType(), model=T.StringType(), raw=T.StringType(), seconds=T.DoubleType(), error=T.StringType(),
)
