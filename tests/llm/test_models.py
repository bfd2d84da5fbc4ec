"""Operators that learn or pack: held-out accuracy, round trips, normalisation, odd rows."""

import math
import os
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from msgscreen.llm import language_id, ngram_lm, packing, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


NEUTRAL = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(6)]


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(1)
    made = []
    for i in range(600):
        toxic = i % 4 == 0
        text = sentence(rng, NEUTRAL, 30)
        # Toxic texts name one group far more often: the bias that the counterfactual term must take out.
        if rng.random() < (0.8 if toxic else 0.1):
            text += ". the muslim neighbour " + sentence(rng, NEUTRAL, 3)
        if toxic:
            text += ". you " + rng.choice(["idiot", "scum", "moron"])
        made.append((i, text, int(toxic)))
    return made


def test_toxicity(spark, labelled):
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in labelled], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled if i < 400] + [(1, None), (10_000, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    plain = toxicity.fit(docs, labels, counterfactual=0.0)
    gap = lambda m: abs(m.weights.get("muslim", 0) - m.weights.get("someone", 0))
    assert gap(model) < 0.3 * gap(plain)
    got = {r.doc_id: r.p for r in toxicity.scored(docs, model, out="p").where("doc_id >= 400").collect()}
    assert np.mean([(got[i] >= 0.5) == y for i, _, y in labelled[400:]]) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "idiot " * 20000), (3, "idiot " * 20000)], "doc_id bigint, text string")
    scores = [r.score for r in toxicity.scored(odd, model).orderBy("doc_id").collect()]
    assert all(0 <= s <= 1 for s in scores) and scores[0] == scores[1] < 0.5 and scores[2] == scores[3]


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert toxicity.scored(docs, model).first().score < 0.5
    assert toxicity.scored(docs.limit(0), model).collect() == []


def test_toxicity_means_the_same_at_every_size(spark):
    """With 13 % toxic labels of 1000, bounds of 2000 and 260 rows read 870 and 130 of the clean ones."""
    rng = random.Random(9)
    made = [(i, sentence(rng, NEUTRAL, 8) + (" scum" if i % 100 < 13 and i % 2 or i % 100 == 50 else ""), int(i % 100 < 13)) for i in range(1000)]
    docs = spark.createDataFrame(made, "doc_id bigint, text string, toxic int")
    whole, part = (toxicity.fit(docs.drop("toxic"), docs.drop("text"), max_rows=n) for n in (2000, 260))
    assert abs(whole.bias - part.bias) < 0.3
    assert whole.scores([""])[0] < 0.5 and part.scores([""])[0] < 0.5


LANGUAGES = {"aa": "ba be bi bo lo la ti", "bb": "krz zrk vsk tsch pfl mnt grd", "cc": "ouie aeio eau oui aia uei iou"}


def test_language(spark):
    rng = random.Random(2)
    word = lambda lang: "".join(rng.choice(LANGUAGES[lang].split()) for _ in range(rng.randint(1, 4)))
    made = [(i, " ".join(word(lang) for _ in range(40)), lang, "x") for i in range(150) for lang in [list(LANGUAGES)[i % 3]]]
    made += [(200, None, "aa", "x"), (201, "", "bb", "x"), (202, "123 !? 45", "cc", "x"), (203, "oui " * 30000, None, "x"), (203, "oui " * 30000, None, "x")]
    docs = spark.createDataFrame(made, "doc_id bigint, text string, lang string, score string")
    model = language_id.fit(docs.where("doc_id < 90"))
    got = {r.doc_id: r.language for r in language_id.identified(docs, model).collect()}
    assert np.mean([got[i].lang == lang for i, _, lang, _ in made[90:150]]) == 1
    assert all(got[i].lang == "und" and got[i].score == 0 for i in (200, 201, 202))
    assert got[203].lang == "cc" and 0 <= got[203].score <= 1
    none = language_id.fit(docs.where("lang = 'zz'"))
    assert {r.language.lang for r in language_id.identified(docs, none).collect()} == {"und"}


def test_parse_is_greedy():
    rng = random.Random(3)
    text = "".join(rng.choice("ab c") for _ in range(120))
    place = {c: i for i, c in enumerate(" abc")}
    edges = language_id.suffix_automaton([place[c] for c in text], 5)
    parser = language_id.Parser(language_id.LanguageModel(["x"], " abc", [edges], [len(text)]))
    for _ in range(30):
        asked = "".join(rng.choice("abc d") for _ in range(rng.randint(1, 600)))
        want = 0
        for a in range(0, len(asked), language_id.SPAN):
            part, at = asked[a : a + language_id.SPAN], 0
            while at < len(part):
                n = 1
                while n < language_id.LONGEST and at + n < len(part) and part[at : at + n + 1] in text:
                    n += 1
                want, at = want + 1, at + n
        assert parser.phrases([asked]).tolist() == [[want]]


def test_ngram_scores(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    made = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(0, 80)))) for i in range(120)]
    made += [(200, None), (201, ""), (202, "  \n"), (203, "Unseen words HERE"), (204, made[5][1]), (204, made[5][1]), (None, made[6][1])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in made], "doc_id bigint, text string, score string").repartition(3)
    train = F.col("doc_id") < 100
    got = ngram_lm.scored(docs, train).collect()
    tokens = lambda t: [w.lower() for w in (t or "").split()] + [None]
    counts: dict = {}
    for i, t in made:
        if i is not None and i < 100:
            for w in tokens(t):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    by_id: dict = {}
    for i, t in made:
        by_id[i] = tokens(t)
    assert len(got) == len(made)
    for r in got:
        own = by_id[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in counts for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert r.score <= 0
    held = [r for r in got if not r.train]
    assert sum(r.score for r in held) > 1.5 * sum(r.base_score for r in held)


def test_ngram_mass(spark):
    """After a context the probabilities of all known words and one unknown word sum to at most 1."""
    made = [(1, "a b a c a b"), (2, "b a"), (3, "c a b")]
    words = ["a", "b", "c", "unseen"]
    asked = [(100 + k, f"a {w}") for k, w in enumerate(words)] + [(200, "a")]
    docs = spark.createDataFrame(made + asked, "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in ngram_lm.scored(docs, F.col("doc_id") < 100).collect()}
    start = {r.doc_id: r for r in ngram_lm.scored(spark.createDataFrame(made + [(300, "")], "doc_id bigint, text string"), F.col("doc_id") < 100).collect()}
    assert start[300].n_tokens == 1 and all(s < 0 for s in got.values())


def brute_scores(made, is_train):
    """Scores of all texts by counts in dictionaries."""
    def grams(t):
        own = ["<"] + [w.lower() for w in t.split()] + [None]
        return [tuple(own[max(0, i - ORDER + 1) : i + 1]) for i in range(1, len(own))]

    one: dict = {}
    high: list = [{} for _ in range(ORDER - 1)]
    starts: list = [{} for _ in range(ORDER - 1)]
    for i, t in made:
        for gram in grams(t) if is_train(i) else ():
            one[gram[-1]] = one.get(gram[-1], 0) + 1
            for k in range(2, len(gram) + 1):
                g, c = high[k - 2], starts[k - 2]
                g[gram[-k:]], c[gram[-k:-1]] = g.get(gram[-k:], 0) + 1, c.get(gram[-k:-1], 0) + 1
    n, weights = sum(one.values()), []
    for g, c in zip(high, starts):
        once, every = np.zeros(64), np.zeros(64)
        for gram, count in g.items():
            kind = c[gram[:-1]].bit_length() - 1
            once[kind] += count == 1
            every[kind] += count
        weights.append(ngram_lm.weights_of(once, every))
    out = {}
    for i, t in made:
        total = 0.0
        for gram in grams(t):
            p = (one.get(gram[-1], 0) + 1) / (n + len(one) + 1)
            for k in range(2, len(gram) + 1):
                seen = starts[k - 2].get(gram[-k:-1], 0)
                if seen:
                    w = weights[k - 2][seen.bit_length() - 1]
                    p = (1 - w) * high[k - 2].get(gram[-k:], 0) / seen + w * p
            total += math.log10(p)
        out[i] = total
    return out


ORDER = 3


def test_ngram_scores_are_those_of_the_whole_text(spark):
    """Neither partitions nor batches, chunks or split contexts move a score."""
    rng = random.Random(7)
    words = [f"w{k}" for k in range(80)]
    made = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(80)], k=rng.randint(0, 60)))) for i in range(300)]
    want = brute_scores(made, lambda i: i < 200)
    for parts, batch, chunk in ((1, 10_000, 8 << 20), (7, 5, 8 << 20), (3, 50, 2000)):
        docs = spark.createDataFrame(made, "doc_id bigint, text string").repartition(parts)
        before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = {r.doc_id: r.score for r in ngram_lm.scored(docs, F.col("doc_id") < 200, chunk_bytes=chunk).collect()}
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_counts_keep_their_class():
    count = np.unique(np.concatenate([np.arange(70_000), 2 ** np.arange(46), 2 ** np.arange(1, 46) - 1]))
    back = ngram_lm.restored(ngram_lm.quantised(count))
    assert (back[:32768] == count[:32768]).all() and (np.abs(back - count) <= count / 2000).all()
    assert (ngram_lm.size_class(back) == ngram_lm.size_class(count)).all()


def test_no_training_text(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    got = ngram_lm.scored(docs, F.lit(False)).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got} == {(1, 3, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0)}
    assert ngram_lm.scored(docs.limit(0), F.lit(True)).collect() == []


def test_elias_fano(tmp_path):
    rng = np.random.default_rng(5)
    for n, top in ((1, 1), (50, 60), (1000, 2**63), (300, 300)):
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        held = ngram_lm.EliasFano(str(tmp_path), f"x{n}", values)
        assert (held[np.arange(n)] == values).all()
        found = held.find(values)
        assert (values[found] == values).all()
        missing = np.setdiff1d(rng.integers(0, top, 100, dtype=np.uint64), values)
        assert (held.find(missing) == -1).all()


ODD = ["", None, "x", "\u2028 tab\there  two\n\nlines <|endoftext|> 's I'll 123abc ٣٤ ünï 日本語 🙂", "a\x1cb\x85c\xa0d", "word " * 9000, "éà" * 500, "don't  'RE"]


def test_pieces_give_the_ids_back(spark):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    letters = "abcdefghij klmnop \n.,'0123456789éüñ-_"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9000))) for _ in range(40)]
    made = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x"), (3, ODD[3], "x")]
    docs = spark.createDataFrame(made, "doc_id bigint, text string, start string").repartition(2)
    got = packing.packed(docs, PATH, block_tokens=20_000).collect()
    model = Tokenizer.from_file(PATH)
    model.encode_special_tokens = True
    ids = {i: model.encode(t or "", add_special_tokens=False).ids + [1] for i, t, _ in made}
    covered: dict = {}
    room: dict = {}
    for r in got:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        covered.setdefault(r.doc_id, []).append((r.start, r.length))
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, parts in covered.items():
        times = sum(1 for k, _, _ in made if k == i)
        assert sum(n for _, n in parts) == times * len(ids[i])
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at < 2048 and at & (at - 1) == 0
    assert packing.packed(docs.limit(0), PATH).collect() == []


def test_added_tokens_keep_their_ids():
    from tokenizers import Tokenizer

    texts = [t or "" for t in ODD] + ["a<|endoftext|>", "<|endoftext|><|endoftext|> b", "x <|endoftext|", "日本<|endoftext|>\n"]
    model = Tokenizer.from_file(PATH)
    got = packing.Tokens(PATH, added_tokens=True).ids(texts)
    assert [g.tolist() for g in got] == [model.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in got[-1] and 50256 in got[-4] and 50256 not in got[-2]


def test_op4_gives_the_ids_of_the_tokenizer_as_loaded(spark, tmp_path):
    from tokenizers import Tokenizer

    from msgscreen.llm.queries import QUERIES

    texts = [t or "" for t in ODD] + ["a<|endoftext|>b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    model = Tokenizer.from_file(PATH)
    got = {r.doc_id: r.doc_tokens for r in QUERIES["op4_packing"](spark, str(tmp_path)).collect()}
    assert got == {i: len(model.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def test_packing_balances_cost():
    rng = random.Random(8)
    lengths = [rng.randint(1, 2000) for _ in range(400)]
    load: dict = {}
    for d, _, length, s, _ in packing.pack(lengths):
        load[s] = load.get(s, 0) + packing.cost(length)
    loads = sorted(load.values())[20:]
    assert sum(loads) / len(loads) > 2048 and max(loads) <= packing.cost(2048)


def test_messages_are_small(tmp_path):
    """Words that recur cost a number, not a hash; counts of mostly one value cost next to nothing."""
    rng = np.random.default_rng(8)
    known = ngram_lm._long(rng.integers(0, 256, 300 * ngram_lm.WORD_BYTES, np.uint8).tobytes(), ngram_lm.WORD_BYTES)
    words = known[np.minimum(rng.zipf(1.3, 20000), 300) - 1]
    raw = ngram_lm._listed(words)
    assert (ngram_lm._unlisted(raw) == words).all() and len(raw) < 1.7 * len(words)
    many = rng.integers(0, 1 << 40, 70000, np.uint64) << np.uint64(24)
    assert (ngram_lm._unlisted(ngram_lm._listed(many)) == many).all()
    counts = np.where(rng.random(20000) < 0.01, 100000, rng.integers(1, 3, 20000))
    raw = ngram_lm._small(counts)
    assert (ngram_lm._large(raw) == counts).all() and len(raw) < 0.5 * len(counts)
    assert len(ngram_lm._large(ngram_lm._small(np.zeros(0, np.int64)))) == 0


def test_many_searches_are_one_pass(tmp_path):
    rng = np.random.default_rng(9)
    values = np.unique(rng.integers(0, 1 << 50, 3000, np.uint64))
    held = ngram_lm.EliasFano(str(tmp_path), "x", values)
    assert (held.whole() == values).all()
    wanted = np.concatenate([values, values + np.uint64(1)])
    lo = rng.integers(0, len(values), len(wanted))
    hi = np.minimum(lo + rng.integers(0, 2000, len(wanted)), len(values))
    few = np.concatenate([held.find(wanted[k : k + 100], lo[k : k + 100], hi[k : k + 100]) for k in range(0, len(wanted), 100)])
    assert (held.find(wanted, lo, hi) == few).all() and (few >= 0).any() and (few < 0).any()
    assert (held[np.arange(0, len(values), 50)] == values[::50]).all()


def test_rising_hashes_are_sent_as_steps():
    """Hashes in order take less than their bytes; falls, repeats and none come back the same."""
    rng = np.random.default_rng(8)
    for size in (8, ngram_lm.CONTEXT_BYTES, ngram_lm.WORD_BYTES):
        cut = np.uint64(64 - 8 * size)
        rising = np.sort(rng.integers(0, 1 << 64, 12000, np.uint64)) >> cut << cut
        raw = ngram_lm._rising(rising, size)
        assert len(raw) < (size - 1) * len(rising)
        for hashes in (rising, rising[::-1], np.repeat(rising[:5], 3), rising[:1], rising[:0]):
            back, rest = ngram_lm._risen(ngram_lm._rising(hashes, size) + b"rest", size)
            assert (back == hashes).all() and len(back) == len(hashes) and rest == b"rest"
    words = rising[rng.permutation(len(rising))]
    raw = ngram_lm._listed(words)
    assert (ngram_lm._unlisted(raw) == words).all() and len(raw) < 5.9 * len(words)


def test_orders_without_stable_sorts():
    rng = np.random.default_rng(9)
    for n in (0, 1, 2, 5000):
        key = rng.integers(0, max(1, n // 3), n).astype(np.uint64) << np.uint64(40)
        assert (ngram_lm._stable(key) == np.argsort(key, kind="stable")).all()
        values, first, at = ngram_lm._distinct(key)
        assert (values == np.unique(key)).all() and (key[first] == values).all() and (values[at] == key).all()


def test_searches_in_the_order_of_what_is_wanted():
    rng = np.random.default_rng(10)
    values = np.unique(rng.integers(0, 9000, 3000).astype(np.uint64))
    for wanted in (rng.integers(0, 9500, 5000).astype(np.uint64), values, values[:0], values[::-1]):
        assert (ngram_lm._searched(values, wanted) == np.searchsorted(values, wanted)).all()


def test_first_pass_frees_its_shuffle(spark):
    tops = [t.getPath() for t in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffles = lambda: {x for top in tops for _, _, names in os.walk(top) for x in names if x.startswith("shuffle_") and x.endswith(".data")}
    had, until = shuffles(), time.time() + 20
    given = spark.createDataFrame([(f"a b c {i}", True) for i in range(100)], "text string, train boolean")
    assert ngram_lm._first_pass(given, 16, 50)[:2] == (500, 104)
    while shuffles() - had and time.time() < until:  # freed beside the next work
        time.sleep(0.2)
    assert not shuffles() - had
