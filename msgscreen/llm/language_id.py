"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed greedily into the longest
phrases (of at most ``LONGEST`` characters) that occur in that language's text; n characters in p phrases against N characters of training
text estimate the cross entropy p * log2(N) / n bits a character. The language needing the fewest
normalised phrases wins.

Fitting reads at most ``ROWS_PER_LANGUAGE`` labelled rows and ``CHARS_PER_LANGUAGE`` characters of each
language (lowest hashes of the id); every text is parsed whole. Parsing restarts every ``SPAN`` characters,
which lets numpy advance many spans in step and bounds memory for texts of any length.

A null text, or one without a letter, is ``und`` with score 0. Without learned languages everything is
``und``. Repeated rows get equal answers; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_LANGUAGE = 24
CHARS_PER_LANGUAGE = 40_000
#: Characters with a symbol of their own; the rest share one.
SYMBOLS = 63
SPAN = 256
#: A phrase ends after so many characters: a passage copied from a training text counts as language, not as a copy.
LONGEST = 8
UNDETERMINED = "und"
RESULT = "struct<lang:string,score:double>"
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-cased words, one blank between them: digits, marks and junk say nothing about the language."""
    return _OTHER.sub(" ", text.lower()).strip()


def suffix_automaton(symbols: list[int], n_symbols: int) -> np.ndarray:
    """Transitions [state, symbol] -> state of the suffix automaton; -1 where no such substring exists."""
    step, link, length = [{}], [-1], [0]
    last = 0
    for c in symbols:
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return np.array([(s, c, t) for s, out in enumerate(step) for c, t in out.items()], np.int32).reshape(-1, 3)


@dataclass
class LanguageModel:
    """Edges of each language's automaton; dense tables are laid out where the model is used."""

    languages: list[str]
    alphabet: str
    edges: list[np.ndarray]
    sizes: list[int]


class Parser:
    def __init__(self, model: LanguageModel):
        self.model = model
        self.width = len(model.alphabet) + 2  # the rest of the characters, and the end of a span
        self.symbol = np.full(0x110000, len(model.alphabet), np.uint8)
        for i, c in enumerate(model.alphabet):
            self.symbol[ord(c)] = i
        self.tables = []
        for edges in model.edges:
            states = int(edges[:, [0, 2]].max()) + 1 if len(edges) else 1
            table = np.full(states * self.width, -1, np.int32)
            table[edges[:, 0].astype(np.int64) * self.width + edges[:, 1]] = edges[:, 2] * self.width
            self.tables.append(table)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Greedy phrases [text, language]."""
        pad = self.width - 1
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        spans = -(-lengths // SPAN)
        flat = self.symbol[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        owner = np.repeat(np.arange(len(texts)), lengths)
        first_span = np.cumsum(spans) - spans
        within = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        grid = np.full((SPAN, int(spans.sum())), pad, np.uint8)
        grid[within % SPAN, first_span[owner] + within // SPAN] = flat
        total = np.zeros((len(texts), len(self.tables)), np.int64)
        of_span = np.repeat(np.arange(len(texts)), spans)
        for k, table in enumerate(self.tables):
            state = np.zeros(grid.shape[1], np.int32)
            count = np.zeros(grid.shape[1], np.int32)
            depth = np.zeros(grid.shape[1], np.int8)
            fresh = table[: self.width].copy()
            fresh[fresh < 0] = 0
            for row in grid:
                following = table[state + row]
                miss = np.flatnonzero(following < 0)
                symbol = row[miss]
                count[miss] += state[miss] > 0  # the phrase before ends here
                unknown = (table[symbol] < 0) & (symbol != pad)
                count[miss] += unknown  # a character the language does not have is a phrase
                following[miss] = fresh[symbol]
                depth[miss] = 0
                depth += following > 0
                full = np.flatnonzero(depth == LONGEST)
                count[full] += 1
                following[full] = depth[full] = 0
                state = following
            count += state > 0
            total[:, k] = np.bincount(of_span, count, minlength=len(texts))
        return total

    def judge(self, texts: list[str | None]) -> list[dict]:
        out = [{"lang": UNDETERMINED, "score": 0.0} for _ in texts]
        cleaned = [letters(t) if t else "" for t in texts]
        asked = [i for i, t in enumerate(cleaned) if any(map(str.isalpha, t))]
        if not asked or not self.tables:
            return out
        lowered = [cleaned[i] for i in asked]
        sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
        bits = self.phrases(lowered) * np.log2(np.maximum(self.model.sizes, 2)) / sizes[:, None]
        best = bits.argmin(axis=1)
        # Certainty: share of the best language when each weighs 2 ** -(bits for a hundred characters).
        weight = np.exp2(-(bits - bits.min(axis=1, keepdims=True)) * np.minimum(sizes, 100)[:, None])
        sure = 1 / weight.sum(axis=1)
        for i, b, s in zip(asked, best.tolist(), sure.tolist()):
            out[i] = {"lang": self.model.languages[b], "score": min(1.0, s)}
        return out


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
        rows: int = ROWS_PER_LANGUAGE, chars: int = CHARS_PER_LANGUAGE) -> LanguageModel:
    """Automata of a bounded sample of rows; short rows (no more than their share of ``chars``) come first."""
    usable = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key)).alias("h"), F.col(key).alias("k")
    )
    long = F.length("text") > 4 * chars // rows
    order = Window.partitionBy("lang").orderBy(long, "h", "k")
    sample = usable.withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows)
    texts: dict[str, str] = {}
    for r in sample.orderBy("lang", "n").select("lang", F.left("text", F.lit(chars)).alias("text")).collect():
        have = texts.get(r["lang"], "")
        texts[r["lang"]] = f"{have} {letters(r['text'])}"[:chars]
    languages = sorted(texts)
    counts: dict[str, int] = {}
    for t in texts.values():
        for c in set(t):
            counts[c] = counts.get(c, 0) + t.count(c)
    alphabet = "".join(sorted(sorted(counts, key=lambda c: (-counts[c], c))[:SYMBOLS]))
    place = {c: i for i, c in enumerate(alphabet)}
    edges = [suffix_automaton([place.get(c, len(alphabet)) for c in texts[x]], len(alphabet) + 1) for x in languages]
    return LanguageModel(languages, alphabet, edges, [len(texts[x]) for x in languages])


def identified(docs: DataFrame, model: LanguageModel, text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct ``out`` of the language and the certainty in [0, 1]."""
    plain = (model.languages, model.alphabet, [e.tobytes() for e in model.edges], model.sizes)
    held = docs.sparkSession.sparkContext.broadcast(plain)  # at most a few bytes per sampled character

    @F.arrow_udf(RESULT)
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        languages, alphabet, edges, sizes = held.value
        edges = [np.frombuffer(e, np.int32).reshape(-1, 3) for e in edges]
        parser = Parser(LanguageModel(languages, alphabet, edges, sizes))
        kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])
        for batch in batches:
            texts, found, part, size = batch.to_pylist(), [], [], 0
            for t in texts:
                part.append(t)
                size += len(t or "")
                if size >= 1 << 21:
                    found += parser.judge(part)
                    part, size = [], 0
            yield pa.array(found + parser.judge(part), kind)

    return docs.withColumn(out, judge(F.col(text)))
