"""Classification metrics. Predictions shrink to a tally first; the rest works on the tally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The valid labels; the first one is the positive class.
VALID = ["phishing", "legitimate"]
POSITIVE, NEGATIVE = VALID


def tally(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and seconds per (keys, true, predicted): one shuffle of already combined counts."""
    return (
        predictions.withColumn("true_label", F.lower(F.trim("true_label")))
        .groupBy(*keys, "true_label", "pred_label")
        .agg(F.count("*").alias("n"), F.sum("response_time").alias("seconds"))
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(top / F.nullif(bottom, F.lit(0)), F.lit(0.0))


def class_scores(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall, F1 and support of every class present in true or predicted labels."""
    valid = counts.where(F.col("pred_label").isin(VALID))
    seen = valid.withColumn("class", F.explode(F.array_distinct(F.array("true_label", "pred_label"))))
    is_true, is_pred = F.col("true_label") == F.col("class"), F.col("pred_label") == F.col("class")

    def rows(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    counted = seen.groupBy(*keys, "class").agg(
        rows(is_true & is_pred).alias("tp"), rows(~is_true & is_pred).alias("fp"), rows(is_true & ~is_pred).alias("fn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counted.select(
        *keys, "class", "tp", "fp", "fn",
        (tp + fn).alias("support"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def summary(predictions: DataFrame, keys: list[str] = ("model",), digits: int = 4) -> DataFrame:
    """One row per model with every rate; models without a valid row are left out.

    One pass: the tally is summed conditionally. A true label outside the valid ones can
    only be missed, so it enters the macro mean as a class with F1 0.
    """
    keys = list(keys)
    true, pred, n = F.col("true_label"), F.col("pred_label"), F.col("n")
    valid = pred.isin(VALID)

    def rows(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(0))

    sums = {"total": F.sum("n"), "valid": rows(valid), "right": rows(valid & (true == pred))}
    for label in VALID:
        sums[f"tp_{label}"] = rows((true == label) & (pred == label))
        sums[f"pred_{label}"] = rows(pred == label)
        sums[f"true_{label}"] = rows(valid & (true == label))
    sums["others"] = F.count_distinct(F.when(valid & ~true.isin(VALID), true))
    sums["seconds"] = F.sum(F.when(valid, F.col("seconds")))
    wide = tally(predictions, keys).groupBy(*keys).agg(*[c.alias(name) for name, c in sums.items()])

    def f1(label: str) -> Column:
        return _ratio(2 * F.col(f"tp_{label}"), F.col(f"pred_{label}") + F.col(f"true_{label}"))

    def present(label: str) -> Column:
        return F.when(F.col(f"pred_{label}") + F.col(f"true_{label}") > 0, 1).otherwise(0)

    classes = present(POSITIVE) + present(NEGATIVE) + F.col("others")
    rates = {
        "accuracy": F.col("right") / F.col("valid"),
        "precision": _ratio(F.col(f"tp_{POSITIVE}"), F.col(f"pred_{POSITIVE}")),
        "recall": _ratio(F.col(f"tp_{POSITIVE}"), F.col(f"true_{POSITIVE}")),
        "f1_phishing": f1(POSITIVE),
        "f1_legitimate": f1(NEGATIVE),
        "f1_macro": (f1(POSITIVE) + f1(NEGATIVE)) / classes,
    }

    def rounded(value: Column, places: int) -> Column:
        # Rounding at 12 digits first removes the order of summation.
        return F.bround(F.round(value, 12), places)

    return wide.where("valid > 0").select(
        *keys,
        *[rounded(value, digits).alias(name) for name, value in rates.items()],
        rounded(F.col("seconds") / F.col("valid"), 2).alias("avg_time"),
        "valid",
        (F.col("total") - F.col("valid")).alias("errors"),
    )


def by_language(predictions: DataFrame, keys: list[str] = ("model", "language")) -> DataFrame:
    """Samples, accuracy and macro F1 per model and language; empty cells are left out."""
    return summary(predictions, list(keys)).select(
        *keys, F.col("valid").alias("samples"), "accuracy", "f1_macro"
    )


def confusion_matrix(predictions: DataFrame, keys: list[str] = ("model",)) -> DataFrame:
    """``(keys, true_label, pred_label, n)`` on the full 2 x 2 grid of valid labels."""
    keys = list(keys)
    counts = tally(predictions, keys)
    grid = [(t, p) for t in (NEGATIVE, POSITIVE) for p in (NEGATIVE, POSITIVE)]
    cells = [
        F.struct(
            F.lit(t).alias("true_label"),
            F.lit(p).alias("pred_label"),
            F.sum(F.when((F.col("true_label") == t) & (F.col("pred_label") == p), F.col("n")).otherwise(0)).alias("n"),
        )
        for t, p in grid
    ]
    return counts.where(F.col("pred_label").isin(VALID)).groupBy(*keys).agg(F.array(*cells).alias("_c")).select(
        *keys, F.inline("_c")
    )


def report(predictions: DataFrame, keys: list[str] = ("model",)) -> DataFrame:
    """Per-class rows, then ``accuracy``, ``macro avg`` and ``weighted avg``."""
    keys = list(keys)
    scores = class_scores(tally(predictions, keys), keys)
    rates = ["precision", "recall", "f1"]
    # Every valid row has its prediction among the classes, so the true positives of all
    # classes are the right answers and the supports add up to the valid rows.
    totals = scores.groupBy(*keys).agg(
        F.sum("support").alias("support"),
        _ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        *[F.avg(r).alias(f"macro_{r}") for r in rates],
        *[_ratio(F.sum(F.col(r) * F.col("support")), F.sum("support")).alias(f"weighted_{r}") for r in rates],
    )
    none = F.lit(None).cast("double")

    def line(name: str, values: list[Column]) -> Column:
        return F.struct(F.lit(name).alias("class"), *[v.alias(r) for v, r in zip(values, rates)])

    lines = F.array(
        line("accuracy", [none, none, F.col("accuracy")]),
        line("macro avg", [F.col(f"macro_{r}") for r in rates]),
        line("weighted avg", [F.col(f"weighted_{r}") for r in rates]),
    )
    overall = totals.select(*keys, "support", F.inline(lines))
    every = scores.select(*keys, "class", *rates, "support").unionByName(overall)
    return every.select(*keys, "class", *[F.round(r, 6).alias(r) for r in rates], "support")


def crosstab(
    predictions: DataFrame, values: list[str] | None = None
) -> DataFrame:
    """Model x predicted label, zeros filled: all labels that occur, or the ``values`` asked for."""
    counts = tally(predictions, ["model"]).groupBy("model")
    return counts.pivot("pred_label", list(values) if values else None).agg(F.sum("n")).na.fill(0)


def label_distribution(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def languages(df: DataFrame) -> DataFrame:
    return df.select("language").distinct().orderBy("language")
