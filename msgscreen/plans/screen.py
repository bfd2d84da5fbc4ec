"""Screening of a batch of messages, from validation to the finished verdict."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from msgscreen import schema
from msgscreen.functions.text import validate_messages
from msgscreen.functions.url import features_to_text, is_url, url_features
from msgscreen.functions.verdict import normalise_verdicts
from msgscreen.operators.context import TEMPLATES, context_blocks, knowledge_blocks, prompts
from msgscreen.operators.embed import Encoder
from msgscreen.operators.fusion import gather, similar_cases
from msgscreen.operators.lexical import LexicalIndex
from msgscreen.plans.retrieve import FINAL, hybrid_search, knowledge_search
from msgscreen.scale import stored


def route_messages(messages: DataFrame, lang: str = "en", strict_urls: bool = False) -> DataFrame:
    """Validated messages with ``channel``, ``url_features`` and the ``search_text`` to retrieve by.

    Rejected messages stay, with their ``error``; their search text is NULL.
    """
    checked = validate_messages(messages)
    ok = F.col("error").isNull()
    url = ok & is_url(F.col("text"), strict_urls)
    features = checked.withColumn("is_url", url).withColumn(
        "url_features", F.when(F.col("is_url"), url_features(F.col("text")))
    )
    return features.withColumns(
        {
            "channel": F.when(ok, F.when(F.col("is_url"), "url").otherwise("message")),
            "search_text": F.when(F.col("is_url"), features_to_text(F.col("url_features"), lang)).when(
                ok, F.col("text")
            ),
        }
    )


def build_prompts(
    queries: DataFrame,
    corpus: DataFrame,
    index: LexicalIndex,
    vectors: DataFrame,
    encoder: Encoder,
    chunks: DataFrame | None = None,
    *,
    k: int = FINAL,
    style: str = "compact",
    template: str = TEMPLATES["screen"],
    case_parts: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(query_id, prompt)`` and the gathered cases behind each prompt.

    With ``case_parts`` the corpus is a case table of so many folders, read only where it holds a winner.
    """
    rows = queries.count()
    run = hybrid_search(queries, index, vectors, encoder, k=k, query_rows=rows)
    cases = gather(run, corpus, rows * k, case_parts)
    knowledge = None
    if chunks is not None:
        knowledge = knowledge_blocks(
            queries.select("query_id"), knowledge_search(queries, chunks, encoder, query_rows=rows)
        )
    return prompts(queries, context_blocks(cases, style), knowledge, template), cases


Responder = Callable[[], Callable[[list[str]], list[str]]]


def ask(prompt_table: DataFrame, model: str, respond: Responder) -> DataFrame:
    """Responses from the user's own model: ``respond()`` loads it once per task process.

    A batch that fails is asked again text by text; a text that fails then has no answer but the
    name of the exception in ``error``, and becomes an error verdict. Failing to load fails the job.
    """

    def run(frames: Iterator) -> Iterator:
        import time

        answer = respond()
        for frame in frames:
            texts = frame["prompt"].tolist()
            start = time.perf_counter()
            try:
                raw, errors = list(answer(texts)), [None] * len(texts)
            except Exception:
                raw, errors = [], []
                for text in texts:
                    try:
                        raw.append(answer([text])[0])
                        errors.append(None)
                    except Exception as error:  # the message's own failure, reported in its row
                        raw.append(None)
                        errors.append(type(error).__name__)
            each = (time.perf_counter() - start) / max(1, len(frame))
            yield frame[["query_id"]].assign(model=model, raw=raw, seconds=each, error=errors)

    return prompt_table.select("query_id", "prompt").mapInPandas(run, schema.RESPONSES)


def ask_models(prompt_table: DataFrame, responders: dict[str, Responder]) -> DataFrame:
    """Responses of several models to the same prompts."""
    return reduce(DataFrame.unionByName, [ask(prompt_table, name, respond) for name, respond in responders.items()])


def attach_verdicts(messages: DataFrame, cases: DataFrame, responses: DataFrame, **options) -> DataFrame:
    """Finished analyses: message, verdict fields, similar cases. Error rows list no cases.

    ``options`` go to ``normalise_verdicts``.
    """
    verdicts = normalise_verdicts(responses, **options).drop("error")  # told by error_type
    listed = similar_cases(cases)
    case_type = listed.schema["similar_cases"].dataType
    joined = messages.join(verdicts, "query_id", "left").join(listed, "query_id", "left")
    failed = F.col("label").isNull() | (F.col("label") == "error")
    return joined.withColumns(
        {
            "similar_cases": F.when(
                failed | F.col("similar_cases").isNull(), F.array().cast(T.ArrayType(case_type.elementType))
            ).otherwise(F.col("similar_cases")),
            "retrieved_examples": F.when(failed, 0).otherwise(F.coalesce("retrieved_examples", F.lit(0))),
        }
    )


def screen_messages(
    messages: DataFrame,
    corpus: DataFrame,
    index: LexicalIndex,
    vectors: DataFrame,
    encoder: Encoder,
    responses: DataFrame | dict[str, Responder],
    *,
    chunks: DataFrame | None = None,
    k: int = FINAL,
    style: str = "compact",
    template: str = TEMPLATES["screen"],
    case_parts: int | None = None,
    **options,
) -> DataFrame:
    """Validate, route, retrieve cases and knowledge, build prompts, get answers, finish the verdicts.

    ``responses`` are answers of an offline batch ``(query_id, model, raw, seconds)`` or the models to
    ask, by name. Routing, encoding and retrieval run once; the result carries ``prompt`` and
    ``knowledge`` beside the verdict (a row per message and model). With ``case_parts`` the corpus is a case table of
    so many folders (``save_cases``), read only where it holds a winner. ``options`` go to ``normalise_verdicts``.
    """
    routed = stored(route_messages(messages), "routed")
    queries = routed.where("search_text IS NOT NULL").select("query_id", F.col("search_text").alias("text"))
    rows = queries.count()
    run = hybrid_search(queries, index, vectors, encoder, k=k, query_rows=rows)
    cases = stored(gather(run, corpus, rows * k, case_parts), "cases")
    known = queries.select("query_id").withColumn("knowledge", F.lit(""))
    if chunks is not None:
        hits = knowledge_search(queries, chunks, encoder, query_rows=rows)
        known = stored(knowledge_blocks(queries.select("query_id"), hits), "knowledge")
    table = prompts(queries, context_blocks(cases, style), known, template)
    if isinstance(responses, dict):
        table = stored(table, "prompts")
        responses = ask_models(table, responses)
    finished = attach_verdicts(routed, cases, responses, **options)
    return finished.join(table, "query_id", "left").join(known, "query_id", "left")
