"""Toxicity by a counterfactual-regularised linear classifier.

Words of labelled texts are the features. Training minimises log loss + ridge + a counterfactual term: in
each labelled sentence that names a group, the term is swapped for the others of its kind and for a neutral
word, and ``COUNTERFACTUAL`` times the squared change of the score is added. Terms of a kind are thereby
pulled to one weight, the neutral one, so that a mere mention of a group does not move the score.

Fitting reads at most ``MAX_ROWS`` labelled texts (lowest hashes of the id, each class its half, all of them
where there are fewer). A class counts as often as it occurs among all labelled rows, whatever share of it was
read, so that 0.5 means the same at every size. Gradient steps are Spark aggregates over that cached sample. Everything else covers
all rows: scoring is one projection over whole texts with at most ``MAX_WORDS`` weights in the closure.

A null or empty text has no words and gets the score of the intercept. Null labels teach nothing. Repeated
rows are scored alike. Without any labelled row every score is 0.5 minus a margin, that is, not toxic.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from msgscreen.llm.common import text_blocks

#: Bounds of the fitting: labelled rows, and words with a weight of their own.
MAX_ROWS = 20_000
MAX_WORDS = 1 << 15
MIN_ROWS_OF_WORD = 5
#: A word whose rows are split over the classes as by chance says nothing; it gets no weight.
MIN_CHI2 = 15.0
STEPS = 60
#: The sample is bounded, and so are the tasks that share a gradient step.
FIT_TASKS = 12
RIDGE = 1e-4
COUNTERFACTUAL = 1.0
NEUTRAL = "someone"

#: Identity terms by kind (English, French, German, Spanish).
IDENTITY_TERMS = {
    "gender": "woman women man men girl boy female male femme homme frau mann mujer hombre transgender",
    "religion": "muslim muslims christian christians jew jews jewish hindu buddhist atheist catholic musulman juif chrétien christ moslem jude musulmán judío cristiano",
    "origin": "black white asian african european arab mexican american french german spanish immigrant immigrants refugee refugees",
    "orientation": "gay lesbian straight bisexual queer homosexual heterosexual",
    "age_or_ability": "old young elderly disabled blind deaf",
}

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def swaps(text: str | None, kinds: dict[str, list[str]]) -> Iterator[tuple[str, str]]:
    """(term, other) for every counterfactual of every sentence that names a group."""
    for sentence in _SENTENCE.split(text.lower()) if text else ():
        present = set(_WORD.findall(sentence))
        for terms in kinds.values():
            for term in terms:
                if term in present:
                    yield from ((term, other) for other in [*terms, NEUTRAL] if other != term and other not in present)


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        weights, keys = self.weights, self.weights.keys()
        z = np.array([self.bias + sum(weights[w] for w in sorted(keys & words_of(t))) for t in texts], float)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _sampled(docs: DataFrame, labels: DataFrame, text: str, label: str, key: str, max_rows: int) -> tuple[DataFrame, dict[int, float]]:
    """Texts of at most half of ``max_rows`` rows of each class, lowest hashes of the id first, and how many
    labelled rows one row of a class stands for.

    Only ids and labels are shuffled; the ids chosen, at most ``max_rows``, go to where the texts are.
    """
    order = Window.partitionBy("y").orderBy("h", "k")
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(F.col(label).cast("int")).alias("y"))
    present = known.join(docs.select(F.col(key).alias("k")), "k", "left_semi").withColumn("h", F.xxhash64("k"))
    chosen = present.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_rows // 2).select("k", "y")
    stands = {r["y"]: max(1.0, r["n"] / (max_rows // 2)) for r in present.groupBy("y").agg(F.count("*").alias("n")).collect()}
    return docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k").select("text", "y"), stands


def fit(
    docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id",
    identity_terms: dict[str, str] | None = None, max_rows: int = MAX_ROWS, steps: int = STEPS,
    counterfactual: float = COUNTERFACTUAL,
) -> ToxicityModel:
    kinds = {k: list(dict.fromkeys(v.split())) for k, v in (identity_terms or IDENTITY_TERMS).items()}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), pa.array([sorted(words_of(t)) for t in texts], pa.list_(pa.string())),
                 pa.array([[f"{a} {b}" for a, b in swaps(t, kinds)] for t in texts], pa.list_(pa.string()))],
                ["y", "words", "swaps"],
            )

    sample, stands = _sampled(docs, labels, text, label, key, max_rows)
    rows = sample.repartition(FIT_TASKS).mapInArrow(features, "y int, words array<string>, swaps array<string>").persist()
    try:
        totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
        positive, negative = totals.get(1, 0), totals.get(0, 0)
        if not positive or not negative:
            return ToxicityModel({}, -4.0 if not positive else 4.0)
        counts = rows.select("y", F.explode("words").alias("word")).groupBy("word").agg(
            F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")
        ).where(F.col("p") + F.col("n") >= MIN_ROWS_OF_WORD)
        # Words ordered by the chi-squared statistic of word against label; identity terms always have a weight.
        rate = positive / (positive + negative)
        expected = (F.col("p") + F.col("n")) * rate
        best = (
            counts.withColumn("chi2", F.pow(F.col("p") - expected, 2) / (expected * (1 - rate)))
            .where(F.col("chi2") >= MIN_CHI2).orderBy(F.desc("chi2"), "word").limit(MAX_WORDS)
        )
        vocabulary = [r["word"] for r in best.select("word").collect()]
        named = {t for terms in kinds.values() for t in terms} | {NEUTRAL}
        vocabulary = sorted(set(vocabulary) | named)
        index = {w: i for i, w in enumerate(vocabulary)}
        encoded = rows.mapInArrow(_encoder(index), "y int, ids array<int>, pairs array<int>").persist()
        try:
            weights = _descend(encoded, len(vocabulary), positive, negative, stands, steps, counterfactual)
        finally:
            encoded.unpersist()
    finally:
        rows.unpersist()
    return ToxicityModel({w: float(v) for w, v in zip(vocabulary, weights[:-1]) if abs(v) > 1e-9}, float(weights[-1]))


def _encoder(index: dict[str, int]):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [[index[w] for w in ws if w in index] for ws in batch.column("words").to_pylist()]
            pairs = [[index[t] for s in ss for t in s.split()] for ss in batch.column("swaps").to_pylist()]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(ids, kind), pa.array(pairs, kind)], ["y", "ids", "pairs"])

    return encode


def _descend(
    rows: DataFrame, size: int, positive: int, negative: int, stands: dict[int, float], steps: int, counterfactual: float
) -> np.ndarray:
    """Adam on the full gradient; classes weigh by the root of their odds among all labelled rows, so a rare class is heard."""
    odds = positive * stands[1] / (negative * stands[0])
    held = np.array([stands[0], stands[1]])
    each = held * [1.0, odds**-0.5]
    total = positive * each[1] + negative * each[0]

    def gradient_of(weights: np.ndarray):
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = np.zeros(size + 1)
            for batch in batches:
                y = batch.column("y").to_numpy()
                ids, pairs = batch.column("ids"), batch.column("pairs")
                at, flat = np.diff(ids.offsets.to_numpy()), ids.flatten().to_numpy()
                doc = np.repeat(np.arange(len(y)), at)
                z = np.bincount(doc, weights[flat], minlength=len(y)) + weights[-1]
                error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * each[y] / total
                g[:-1] += np.bincount(flat, error[doc], minlength=size)
                g[-1] += error.sum()
                a, b = pairs.flatten().to_numpy().reshape(-1, 2).T
                change = 2 * counterfactual * (weights[a] - weights[b]) * np.repeat(held[y], np.diff(pairs.offsets.to_numpy()) // 2) / total
                g[:-1] += np.bincount(a, change, minlength=size) - np.bincount(b, change, minlength=size)
            yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary())], ["g"])

        parts = rows.mapInArrow(partial, "g binary").collect()  # FIT_TASKS vectors of at most MAX_WORDS weights
        return np.sum([np.frombuffer(r["g"]) for r in parts], axis=0)

    weights, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    weights[-1] = np.log(odds)
    for step in range(1, steps + 1):
        g = gradient_of(weights)
        g[:-1] += RIDGE * weights[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        weights = weights - 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return weights


def scored(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of the toxic class; all other columns pass through."""
    weights, bias = model.weights, model.bias

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = ToxicityModel(weights, bias)
        for texts in batches:
            for block in text_blocks(texts):
                yield pa.array(held.scores([t.decode() for t in block]), pa.float64())

    return docs.withColumn(out, score(F.col(text)))
