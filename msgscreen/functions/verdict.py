"""Model answers: find the JSON, parse it, normalise its fields. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgscreen.functions.bind import bind
from msgscreen.functions.text import strip

_WS = r"[\s\x1c-\x1f]*"
_THINK = r"(?s)<think>.*?</think>"
_FENCED = r"(?sU)```(?:json)?" + _WS + r"(\{.*?\})" + _WS + "```"
_BRACES = r"(?s)\{.*\}"

# Words for a confidence, and the score bands.
CONFIDENCE_WORDS = {"low": 0.3, "medium": 0.6, "high": 0.9}
CRITICAL_FROM, MEDIUM_FROM = 70, 40
LEGITIMATE_RISK_MAX = 30

ERROR_ADVICE = "Please try again."


def extract_json(raw: Column, mode: str = "fenced") -> Column:
    """JSON text inside an answer, NULL when there is none.

    ``fenced``: drop think tags, prefer a fenced block, else outermost braces.
    ``greedy``: outermost braces of the untouched answer.
    ``fallback``: as ``fenced``, else the stripped answer itself.
    """

    def found(text: Column, pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))

    def pick(spoken: Column) -> Column:
        choices = [found(spoken, _FENCED, 1), found(spoken, _BRACES, 0)]
        return F.coalesce(*choices, strip(spoken)) if mode == "fallback" else F.coalesce(*choices)

    if mode == "greedy":
        return found(raw, _BRACES, 0)
    if mode in ("fenced", "fallback"):
        return bind(F.regexp_replace(raw, _THINK, ""), pick)
    raise ValueError(f"unknown mode {mode!r}")


def python_round2(value: Column) -> Column:
    """Round a double in [0, 1] to two digits, half to even on its exact binary value.

    Scaling by 2**60 is exact for every double of at least 2**-8 (smaller ones round to 0
    either way). Split into high and low 30 bits, hundredfold values fit a BIGINT, so whole
    and rest come out of integer arithmetic.
    """
    part = 1 << 30

    def settle(scaled: Column) -> Column:
        low = scaled.bitwiseAND(F.lit(part - 1)) * 100
        high = F.shiftright(scaled, 30) * 100 + F.shiftright(low, 30)
        return bind(F.struct(high.alias("high"), low.bitwiseAND(F.lit(part - 1)).alias("low")), nearest)

    def nearest(s: Column) -> Column:
        whole, rest = F.shiftright(s["high"], 30), s["high"].bitwiseAND(F.lit(part - 1))
        half = F.lit(part >> 1)
        up = (rest > half) | ((rest == half) & ((s["low"] > 0) | (whole.bitwiseAND(F.lit(1)) == 1)))
        return (whole + F.when(up, 1).otherwise(0)).cast("double") / F.lit(100.0)

    return bind((value * F.lit(float(1 << 60))).cast("bigint"), settle)


def _kind(variant: Column) -> Column:
    return F.coalesce(F.schema_of_variant(variant), F.lit("VOID"))


def confidence_value(parsed: Column) -> Column:
    """Confidence clamped to [0, 1]: words low/medium/high, numbers and booleans count, else 0."""

    def value(field: Column) -> Column:
        word = F.lower(F.try_variant_get(field, "$", "string"))
        by_word = F.lit(0.0)
        for name, score in CONFIDENCE_WORDS.items():
            by_word = F.when(word == name, F.lit(score)).otherwise(by_word)
        number = F.coalesce(F.try_variant_get(field, "$", "double"), F.lit(0.0))
        return (
            F.when(_kind(field) == "STRING", by_word)
            .when(_kind(field) == "BOOLEAN", F.when(word == "true", 1.0).otherwise(0.0))
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))
        )

    return bind(F.try_variant_get(parsed, "$.confidence", "variant"), value)


def risk_value(parsed: Column) -> Column:
    """Integer score: numbers truncate, digit strings parse, everything else is 0."""

    def value(field: Column) -> Column:
        word = F.trim(F.try_variant_get(field, "$", "string"))
        number = F.try_variant_get(field, "$", "double")
        digits = F.regexp_replace(word, r"^([+-]?)0+(?=\d)", "$1")
        # Beyond 64 bits the score saturates; its band is the same.
        extreme = F.when(F.startswith(digits, F.lit("-")), F.lit(-(2**63))).otherwise(F.lit(2**63 - 1))
        parsed_digits = F.coalesce(digits.try_cast("bigint"), extreme)
        score = (
            F.when(_kind(field) == "STRING", F.when(word.rlike(r"^[+-]?\d+$"), parsed_digits))
            .when(_kind(field) == "BOOLEAN", F.when(word == "true", 1).otherwise(0))
            .otherwise(F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)))
        )
        return F.coalesce(score.cast("bigint"), F.lit(0).cast("bigint"))

    return bind(F.try_variant_get(parsed, "$.risk_score", "variant"), value)


def label_two_way(label: Column) -> Column:
    """Anything that does not mention phishing counts as legitimate."""
    return F.when(F.contains(F.lower(F.coalesce(label, F.lit(""))), F.lit("phishing")), "phishing").otherwise(
        "legitimate"
    )


def label_three_way(label: Column) -> Column:
    bare = F.lower(F.translate(F.coalesce(label, F.lit("unknown")), "\"'", ""))
    return (
        F.when(F.contains(bare, F.lit("phishing")), "phishing")
        .when(F.contains(bare, F.lit("legitimate")), "legitimate")
        .otherwise("unknown")
    )


def risk_level(score: Column) -> Column:
    return F.when(score >= CRITICAL_FROM, "critical").when(score >= MEDIUM_FROM, "medium").otherwise("low")


def normalise_verdicts(
    responses: DataFrame,
    *,
    raw: str = "raw",
    labels: str = "three",
    mode: str = "fenced",
    round_confidence: bool = True,
    models: list[str] | None = None,
) -> DataFrame:
    """Add the typed verdict fields to a table of raw answers.

    Every row stays: an answer without usable JSON gets label ``error``, risk 0 and
    ``error_type`` (``no_json``, ``json_parse`` or ``not_an_object``; ``unknown_model`` for an
    answer under a name outside ``models``; the exception's name where the model failed).
    """
    if labels not in ("two", "three"):
        raise ValueError(f"labels must be 'two' or 'three', not {labels!r}")
    json = F.when(F.coalesce(F.length(raw), F.lit(0)) > 0, extract_json(F.col(raw), mode))
    absent = F.lit("json_parse" if mode == "fallback" else "no_json")

    def fault(text: Column) -> Column:
        return F.when(text.isNull() | (text == ""), absent).otherwise(bind(F.try_parse_json(text), bad_shape))

    def bad_shape(parsed: Column) -> Column:
        return F.when(parsed.isNull(), F.lit("json_parse")).when(
            ~F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), F.lit("not_an_object")
        )

    staged = responses.withColumn("_json", json)
    error = bind(F.col("_json"), fault)
    if "error" in responses.columns:  # the model failed on this message
        error = F.coalesce(F.col("error"), error)
    if models is not None:
        error = F.when(~F.col("model").isin(models), F.lit("unknown_model")).otherwise(error)
    staged = staged.withColumns({"_v": F.try_parse_json("_json"), "error_type": error})
    v = F.col("_v")
    bad = F.col("error_type").isNotNull()

    def text(name: str, default: str = "") -> Column:
        return F.when(bad, F.lit(default)).otherwise(
            F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit(default))
        )

    label = F.try_variant_get(v, "$.label", "string")
    v_elements = F.try_variant_get(v, "$.suspicious_elements", "variant")
    confidence = F.when(bad, F.lit(0.0)).otherwise(confidence_value(v))
    staged = staged.withColumns(
        {
            "label": F.when(bad, "error").otherwise(
                label_two_way(label) if labels == "two" else label_three_way(label)
            ),
            "confidence": python_round2(confidence) if round_confidence else confidence,
            "risk_score": F.when(bad, F.lit(0).cast("bigint")).otherwise(risk_value(v)),
            "answer_language": text("language"),
            "attack_type": text("attack_type"),
            "explanation": F.when(
                bad, F.concat(F.lit("Analysis failed: "), F.col("error_type"))
            ).otherwise(text("explanation")),
            "suspicious_elements": F.when(bad, F.array().cast("array<string>")).otherwise(
                F.coalesce(
                    F.try_variant_get(v, "$.suspicious_elements", "array<string>"),
                    # A single element may come without its list.
                    F.when(_kind(v_elements) == "STRING", F.array(F.try_variant_get(v, "$.suspicious_elements", "string"))),
                    F.array().cast("array<string>"),
                )
            ),
            "recommendation": F.when(bad, F.lit(ERROR_ADVICE)).otherwise(text("recommendation")),
        }
    )
    return staged.withColumns(
        {
            "classification": F.col("label"),
            "recommendations": F.col("recommendation"),
            "risk_level": risk_level(F.col("risk_score")),
            "confidence_pct": (F.col("confidence") * 100).cast("int"),
            "risk_consistent": (F.col("label") != "legitimate")
            | F.col("risk_score").between(0, LEGITIMATE_RISK_MAX),
        }
    ).drop("_json", "_v")


def quoted_list(items: Column) -> Column:
    """An array of strings in bracketed, single-quoted form: ``['a', 'b']``."""

    def quote(item: Column) -> Column:
        mark = F.when(F.contains(item, F.lit("'")) & ~F.contains(item, F.lit('"')), '"').otherwise("'")
        return F.concat(mark, item, mark)

    return F.concat(F.lit("["), F.array_join(F.transform(items, quote), ", "), F.lit("]"))


def prediction_rows(verdicts: DataFrame, true_label: str = "true_label", language: str = "language") -> DataFrame:
    """Classification-benchmark rows from normalised verdicts."""
    return verdicts.select(
        "model",
        F.lower(F.trim(F.col(true_label))).alias("true_label"),
        F.col("label").alias("pred_label"),
        "confidence",
        "risk_score",
        "attack_type",
        "recommendation",
        "explanation",
        quoted_list(F.col("suspicious_elements")).alias("suspicious"),
        F.bround(F.col("seconds"), 2).alias("response_time"),
        F.coalesce(F.col(language), F.lit("unknown")).alias("language"),
    )
