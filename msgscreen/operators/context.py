"""Context blocks and prompts as text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Layout of one example, by style.
EXAMPLE_LAYOUTS = {
    "compact": (
        "\nExample {rank}\nText: {text}\nLabel: {label}\nLanguage: {language}\n"
        "Attack Type: {attack_type}\nRisk Level: {risk_level}\n"
    ),
    "spaced": (
        "\nExample {rank}\n\nText:\n{text}\n\nLabel:\n{label}\n\nLanguage:\n{language}\n\n"
        "Attack Type:\n{attack_type}\n\nRisk Level:\n{risk_level}\n"
    ),
}
# Layout of the knowledge part.
KNOWLEDGE_HEAD = "\nPDF Knowledge:\n"
KNOWLEDGE_LAYOUT = "\n    Document {rank}:\n    {chunk}\n\n    "

ANSWER_FORMAT = (
    '{"label": "phishing|legitimate", "confidence": <0.0-1.0>, "risk_score": <0-100>, '
    '"language": "en|fr|ar", "attack_type": "<type or none>", "explanation": "<one sentence>", '
    '"suspicious_elements": ["<element>"], "recommendation": "<action>"}'
)

#: Default templates; ``[[context]]`` and ``[[message]]`` are filled per query.
TEMPLATES = {
    "screen": (
        "You judge whether a message is phishing.\n"
        "Known cases and reference material:\n[[context]]\n\n"
        "Message to judge:\n[[message]]\n\n"
        "Look for pressure to act, doubtful links, borrowed brands, requests for personal data and "
        "promised prizes. Name a specialised attack by its usual term. Answer in the language of the "
        "message, with one JSON object and nothing else; a legitimate message scores at most 30:\n"
        + ANSWER_FORMAT
    ),
    "cases_only": (
        "You judge whether a message is phishing.\nKnown cases:\n[[context]]\n\n"
        "Message to judge:\n[[message]]\n\nAnswer with one JSON object and nothing else; a legitimate "
        "message scores at most 30:\n" + ANSWER_FORMAT
    ),
    "no_context": (
        "You judge whether a message is phishing.\nMessage to judge:\n[[message]]\n\n"
        "Answer with one JSON object, without reasoning, markdown or fences:\n" + ANSWER_FORMAT
    ),
}


def fill(template: str, values: dict[str, Column], mark: tuple[str, str] = ("{", "}")) -> Column:
    """Concatenate a template with columns in place of its marked names.

    Inserted text is never searched again, so braces inside a message are harmless.
    """
    import re

    pattern = "|".join(re.escape(mark[0] + name + mark[1]) for name in values)
    pieces: list[Column] = []
    for part in re.split(f"({pattern})", template):
        name = part[len(mark[0]) : len(part) - len(mark[1])]
        if part.startswith(mark[0]) and name in values:
            pieces.append(values[name])
        elif part:
            pieces.append(F.lit(part))
    return F.concat(*pieces)


def context_blocks(gathered: DataFrame, style: str = "compact") -> DataFrame:
    """``(query_id, context)``: numbered examples of each query in rank order (k per query)."""
    fields = ["text", "label", "language", "attack_type", "risk_level"]
    missing = F.lit("None")
    values = {name: F.coalesce(F.col(name), missing) for name in fields}
    entry = fill(EXAMPLE_LAYOUTS[style], {"rank": F.col("rank").cast("string"), **values})
    return (
        gathered.select("query_id", F.struct("rank", entry.alias("entry")).alias("e"))
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list("e")).alias("_e"))
        .select("query_id", F.array_join(F.col("_e.entry"), "\n").alias("context"))
    )


def knowledge_blocks(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """``(query_id, knowledge)``; queries without chunks get an empty string.

    ``hits(query_id, rank, chunk)`` holds k rows per query.
    """
    entry = fill(KNOWLEDGE_LAYOUT, {"rank": F.col("rank").cast("string"), "chunk": F.col("chunk")})
    blocks = (
        hits.select("query_id", F.struct("rank", entry.alias("entry")).alias("e"))
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list("e")).alias("_e"))
        .select(
            "query_id",
            F.concat(F.lit(KNOWLEDGE_HEAD), F.array_join(F.col("_e.entry"), "")).alias("_k"),
        )
    )
    return queries.join(blocks, "query_id", "left").select(
        *queries.columns, F.coalesce("_k", F.lit("")).alias("knowledge")
    )


def prompts(
    queries: DataFrame,
    context: DataFrame | None = None,
    knowledge: DataFrame | None = None,
    template: str = TEMPLATES["screen"],
    text: str = "text",
) -> DataFrame:
    """``(query_id, prompt)`` from a template with ``[[context]]`` and ``[[message]]``."""
    staged = queries.select("query_id", F.col(text).alias("_message"))
    for side, name in ((context, "context"), (knowledge, "knowledge")):
        if side is not None:
            staged = staged.join(side.select("query_id", name), "query_id", "left")
        else:
            staged = staged.withColumn(name, F.lit(""))
    both = F.concat(F.coalesce("context", F.lit("")), F.coalesce("knowledge", F.lit("")))
    values = {"context": both, "message": F.coalesce("_message", F.lit(""))}
    return staged.select("query_id", fill(template, values, ("[[", "]]")).alias("prompt"))
