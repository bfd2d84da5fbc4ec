"""Near-duplicates by bottom-k sketches from one hash function.

1. A document's set holds its distinct ``WORDS``-word shingles (fewer words: the whole sequence as one). One
   hash function orders all shingles; the sketch keeps the ``K`` smallest. Documents of equal sets form a class.
2. Inverted lists of the retained values. Two sets of similarity t share at least ``required(n)`` retained
   values (certain for sets the sketch holds whole; else with a miss chance below ``MISS`` a pair). A class
   with s shared values therefore meets every partner on one of its ``s - required + 1`` rarest shared
   values, and only these are indexed: values of lines that many documents carry stay out of the lists.
3. Lists are joined through hubs, not all pairs: each list has one hub, its members are paired with it. A pair's
   overlap in the bottom-k of the union estimates its similarity; what may reach t is verified on the full
   sets. Links give components. Lists whose members lie in more than one component get another hub. Members of
   lists that are still shared by components after ``HUB_ROUNDS`` rounds are listed anew by the rarest
   shingles of their full sets, and pairs of different components in one such list are all judged: no
   pair that the sketches let through stays unjudged, and passages short of t never pair documents.

Hot lists and hubs are salted into groups of about ``GROUP`` members; copies are never expanded; components
are found by label rounds on Spark tables in the shared folder. Nothing of corpus size reaches the driver.

A text that is null or without words has an empty set and links with nothing. Rows without an id link with
nothing and are kept. Rows that repeat an id are one document. Extra columns take no part.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgscreen.llm.common import BLANK, LOWER, Tables, Words, blocks, text_blocks

WORDS = 5
K = 64
PERCENT = 85
MISS = 1e-9
HUB_ROUNDS = 2
GROUP = 256

SKETCH = "struct<n:bigint,sig:binary,sketch:array<bigint>>"


def truncated_bound(k: int = K, percent: int = PERCENT, miss: float = MISS) -> int:
    """Largest s such that fewer than s of k draws hit a share of ``percent`` with a chance below ``miss``."""
    t, total, s = percent / 100, 0.0, 0
    while True:
        total += math.comb(k, s) * t**s * (1 - t) ** (k - s)
        if total > miss:
            return s
        s += 1


def required(n: Column, k: int = K, percent: int = PERCENT) -> Column:
    """Retained values a set of n shingles shares with any partner."""
    whole = F.ceil(n * percent / 100)
    return F.when(n * 100 <= k * percent, whole).otherwise(F.lit(truncated_bound(k, percent))).cast("int")


def sets_of(texts: list[bytes], size: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    for a, b in blocks(texts):
        words = Words([t.translate(LOWER) for t in texts[a:b]], BLANK == 0)
        first, h = words.windows(size)
        doc = words.doc[first]
        edge = np.searchsorted(doc, np.arange(b - a + 1))
        ends = np.cumsum(words.counts)
        for i in range(b - a):
            n = int(words.counts[i])
            if n >= size:
                yield np.unique(h[edge[i] : edge[i + 1]])
            elif n:
                whole = words.hash[ends[i] - n : ends[i]].tobytes()
                yield np.frombuffer(hashlib.blake2b(whole, digest_size=8).digest(), np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def shingles_of(text: bytes, size: int = WORDS) -> set[bytes]:
    """The full set itself: shingles as bytes, for verification."""
    words = text.translate(LOWER).split()
    if len(words) < size:
        return {b" ".join(words)} if words else set()
    return {b" ".join(g) for g in zip(*[words[j:] for j in range(size)])}


def _sketcher(size: int, k: int):
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("n", pa.int64()), ("sig", pa.binary()), ("sketch", pa.list_(pa.int64()))])
        for batch in batches:
            for texts in text_blocks(batch):
                rows = [  # copies, since a view would keep the whole set
                    {"n": len(u), "sig": hashlib.blake2b(u.tobytes(), digest_size=16).digest(), "sketch": u[:k].view(np.int64).copy()}
                    for u in sets_of(texts, size)
                ]
                yield pa.array(rows, kind)

    return F.arrow_udf(sketch, SKETCH)


def _meet(pairs: DataFrame, items: DataFrame, judge, schema: str) -> DataFrame:
    """``judge(hub payloads, member ids, member payloads)`` for every hub ``a`` and its members ``b``, in salted groups."""
    load = pairs.groupBy("a").agg(F.count("*").alias("m"))
    salted = pairs.join(load, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / GROUP)).alias("salt"))
    hubs = salted.select(F.col("a").alias("id"), "a", "salt", F.lit(True).alias("hub")).distinct()
    needs = salted.select(F.col("b").alias("id"), "a", "salt", F.lit(False).alias("hub")).unionAll(hubs)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        ids, hub, payload = (rows.column(c).to_pylist() for c in ("id", "hub", "payload"))
        a = rows.column("a")[0].as_py()
        centre = [p for p, h in zip(payload, hub) if h]
        members = [(i, p) for i, p, h in zip(ids, payload, hub) if not h]
        found = judge(centre, members)
        columns = [pa.array([a] * len(found), pa.int64()), pa.array([f[0] for f in found], pa.int64())]
        if "est" in schema:
            columns.append(pa.array([f[1] for f in found], pa.float64()))
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    rows = needs.join(items, "id").select("id", "a", "salt", "hub", "payload")
    return rows.groupBy("a", "salt").applyInArrow(group, schema)


def _estimator(k: int, percent: int):
    least = truncated_bound(k, percent)

    def judge(centre, members):
        found = []
        for i, other in members:
            b = np.frombuffer(other, np.uint64)
            best = 0.0
            for mine in centre:
                a = np.frombuffer(mine, np.uint64)
                union = np.union1d(a, b)
                whole = len(a) < k and len(b) < k
                low = union if whole else union[:k]
                shared = len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), low, assume_unique=True))
                if shared * 100 >= percent * len(low) or not whole and shared >= least:
                    best = max(best, shared / len(low))
            if best > 0:
                found.append((i, best))
        return found

    return judge


def _verifier(size: int, percent: int):
    def judge(centre, members):
        sets = [shingles_of(zlib.decompress(t), size) for t in centre]
        found = []
        for i, text in members:
            other = shingles_of(zlib.decompress(text), size)
            for mine in sets:
                both = len(mine & other)
                if both and 100 * both >= percent * (len(mine) + len(other) - both):
                    found.append((i,))
                    break
        return found

    return judge


def components(links: DataFrame, tables: Tables | None = None) -> DataFrame:
    """(id, comp): smallest id reachable over ``links`` (a, b). Label rounds with pointer jumps."""
    tables = tables or Tables(links.sparkSession, "components")
    both = tables.put("both", links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = tables.put("round", both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("comp")))
    while True:
        near = both.join(label.select(F.col("id").alias("b"), F.col("comp").alias("near")), "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        lower = label.join(near, "id", "left").select("id", "comp", F.least("comp", "near").alias("low"))
        jump = label.select(F.col("id").alias("low"), F.col("comp").alias("far"))
        after = tables.put("round", lower.join(jump, "low", "left").select("id", F.least("low", "far").alias("comp"), F.col("comp").alias("was")))
        moved = after.where("comp <> was").limit(1).count()
        label = after.select("id", "comp")
        if not moved:
            tables.drop("both")
            return label


def _merged(label: DataFrame | None, links: DataFrame, tables: Tables) -> DataFrame:
    """Labels after more links: the links are contracted to components first."""
    if label is None:
        merged = tables.put("label", components(links, tables))
        tables.drop("round")
        return merged
    of = lambda side: label.select(F.col("id").alias(side), F.col("comp").alias(f"{side}_comp"))
    short = (
        links.join(of("a"), "a", "left").join(of("b"), "b", "left")
        .select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")).where("a <> b").distinct()
    )
    fresh = components(tables.put("short", short), tables)
    moved = fresh.select(F.col("id").alias("comp"), F.col("comp").alias("to"))
    old = label.join(moved, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
    new = fresh.join(label.select("id"), "id", "left_anti")
    merged = tables.put("label", old.unionAll(new))
    tables.drop("short", "round")
    return merged


def linked(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS, k: int = K, percent: int = PERCENT
) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    given = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    tables = Tables(spark, "bottomk")
    sketches = tables.put("sketches", given.select("id", _sketcher(size, k)(F.col("text")).alias("s")).select("id", "s.*"))
    filled = sketches.where("n > 0 AND id IS NOT NULL")
    reps = filled.groupBy("sig").agg(F.min("id").alias("rep"))
    classes = filled.join(reps.select("sig", F.col("rep").alias("id")), ["sig", "id"]).dropDuplicates(["sig", "id"])
    classes = tables.put("classes", classes.select("id", "n", "sketch"))

    # Inverted lists: only values that two classes share, only the rarest of each class.
    values = classes.select("id", "n", F.explode("sketch").alias("value"))
    shared = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    owned = values.join(shared, "value").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("vs"))
    room = F.size("vs") - required(F.col("n"), k, percent) + 1
    postings = tables.put(
        "postings",
        owned.where(room > 0).select("id", "n", F.explode(F.slice("vs", F.lit(1), room)).alias("v")).select("id", "n", F.col("v.value").alias("value")),
    )
    partners = postings.select("id").distinct()
    packed = F.arrow_udf(_zipped, "binary")
    whole = given.where("id IS NOT NULL").join(partners, "id").dropDuplicates(["id", "text"])
    texts = tables.put("texts", whole.select("id", packed(F.coalesce("text", F.lit(""))).alias("payload")))
    bits = classes.join(partners, "id").select("id", F.arrow_udf(_bits, "binary")(F.col("sketch")).alias("payload"))

    label, rest = None, None
    for turn in range(HUB_ROUNDS + 1):
        members = postings if label is None else postings.join(label, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        if turn < HUB_ROUNDS:
            pairs = _hub_pairs(members, turn, percent)
        else:
            pairs = _pairs_apart(_full_postings(members, texts, size, percent, tables).join(label, "id", "left").withColumn("comp", F.coalesce("comp", "id")), percent)
        pairs = tables.put("pairs", pairs)
        likely = tables.put(f"likely{turn}", _meet(pairs, bits, _estimator(k, percent), "a bigint, b bigint, est double"))
        if turn == 0:
            # Every member tries its likeliest hub first; the others only matter if that leaves it apart.
            best = likely.groupBy("b").agg(F.max_by("a", F.struct("est", -F.col("a"))).alias("a")).select("a", "b")
            rest, likely = likely.select("a", "b"), best
        else:
            likely = likely.select("a", "b")
            if rest is not None:
                likely, rest = likely.unionAll(_apart(rest, label)).distinct(), None
        links = tables.put("links", _meet(tables.put("judged", likely), texts, _verifier(size, percent), "a bigint, b bigint"))
        if label is None or not links.isEmpty():
            label = _merged(label, links, tables)
    tables.drop(*set(tables.paths) - {"sketches", "label"})

    named = reps.join(label.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("sig", F.coalesce("comp", "rep").alias("comp"))
    found = filled.select("id", "n", "sig").join(named, "sig").select("id", "n", "comp")
    empty = sketches.where("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("comp"))
    return found.unionAll(empty).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"),
        F.coalesce(F.col("id") == F.col("comp"), F.lit(True)).alias("kept"),
    )


def _zipped(values: pa.Array) -> pa.Array:
    return pa.array([zlib.compress(t, 1) for texts in text_blocks(values) for t in texts], pa.binary())


def _bits(values: pa.Array) -> pa.Array:
    return pa.array([np.sort(np.array(v, np.int64).view(np.uint64)).tobytes() for v in values.to_pylist()], pa.binary())


def _fits(x: str, y: str, percent: int) -> Column:
    return (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    of = lambda side: label.select(F.col("id").alias(side), F.col("comp").alias(f"{side}_comp"))
    joined = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return joined.where(F.coalesce("a_comp", "a") != F.coalesce("b_comp", "b")).select("a", "b")


def _hub_pairs(members: DataFrame, turn: int, percent: int) -> DataFrame:
    """Every member of a list with the list's hub: the lowest id at first, then by a hash of the id and turn."""
    order = F.struct("id", "n") if turn == 0 else F.struct(F.xxhash64("id", F.lit(turn)).alias("o"), "id", "n")
    comp = "comp" if "comp" in members.columns else "id"
    hubs = members.groupBy("value").agg(
        F.min(order).alias("hub"), F.min(comp).alias("first"), F.max(comp).alias("last"),
        F.min_by(F.col(comp), order).alias("hub_comp"),
    ).where("first <> last").select("value", F.col("hub.id").alias("a"), F.col("hub.n").alias("an"), "hub_comp")
    met = members.join(hubs, "value").where((F.col(comp) != F.col("hub_comp")) & _fits("n", "an", percent))
    return met.select("a", F.col("id").alias("b")).distinct()


def _full_postings(members: DataFrame, texts: DataFrame, size: int, percent: int, tables: Tables) -> DataFrame:
    """Exact lists for the members of lists that components still share: (id, n, value, rest), ``rest`` values from here on.

    Of the shingles that two of these documents share, each is listed under its rarest: so many that a partner
    of similarity t cannot avoid them all. A passage of less than a share t of a document is never listed.
    """
    mixed = members.groupBy("value").agg(F.min("comp").alias("first"), F.max("comp").alias("last")).where("first <> last")
    asked = members.join(mixed.select("value"), "value", "left_semi").select("id").distinct()

    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for zipped in text_blocks(batch):
                rows = [u.view(np.int64) for u in sets_of([zlib.decompress(t) for t in zipped], size)]
                yield pa.array(rows, pa.list_(pa.int64()))

    whole = texts.join(asked, "id").select("id", F.arrow_udf(sets, "array<bigint>")(F.col("payload")).alias("s"))
    values = tables.put("values", whole.select("id", F.size("s").cast("bigint").alias("n"), F.explode("s").alias("value")))
    shared = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    owned = values.join(shared, "value").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("vs"))
    room = F.size("vs") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    listed = owned.where(room > 0).select("id", "n", F.size("vs").alias("m"), F.posexplode(F.slice("vs", F.lit(1), room)).alias("at", "v"))
    return tables.put("listed", listed.select("id", "n", F.col("v.value").alias("value"), (F.col("m") - F.col("at")).cast("bigint").alias("rest")))


def _pairs_apart(members: DataFrame, percent: int) -> DataFrame:
    """Members outside the largest component of their list with all members of other components."""
    sizes = members.groupBy("value", "comp").agg(F.count("*").alias("m"))
    main = sizes.groupBy("value").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.count("*").alias("c")).where("c > 1")
    listed = members.join(main.select("value", "main"), "value")
    few = listed.where("comp <> main").select(
        "value", F.col("id").alias("a"), F.col("n").alias("an"), F.col("comp").alias("ac"), F.col("rest").alias("arest")
    )
    # At the first value that two sets share, all they share is still ahead in both lists.
    enough = F.least("rest", "arest") * (100 + percent) >= (F.col("n") + F.col("an")) * percent
    met = listed.join(few, "value").where(
        (F.col("comp") != F.col("ac")) & ((F.col("comp") == F.col("main")) | (F.col("a") < F.col("id"))) & _fits("n", "an", percent) & enough
    )
    return met.select("a", F.col("id").alias("b")).distinct()
