"""Secret scan: fixed shapes, plus tokens that a battery of randomness tests tells from prose. SQL functions only.

Shapes (leftmost, non-overlapping each): assignments of a password-like name, access keys, long hex runs.

Battery, for every maximal run of ``[A-Za-z0-9+/_=-]`` of ``MIN_TOKEN`` or more characters. Its encoding is
inferred from its characters (hex, base32, digits and letters, base64 and its URL-safe form), giving an
alphabet of A symbols. Then
* chi-squared of the symbol counts against the uniform alphabet,
* runs: changes between lower case, upper case, digits and the rest along the token,
* serial correlation: lag-1 correlation of the symbols' places in the alphabet.
A token is random if neither chi-squared nor runs rejects uniform symbols at ``REJECT_Z``. How far it is
from prose is the sum of the three statistics, standardised by what prose of that length and alphabet
gives (``PROSE_*``), so short tokens need stronger signs than long ones. Letters of one case have no changes of class and no
order that prose would show, so they are judged by chi-squared alone; digits alone are not tested, as nothing tells
random ones from long numbers. The resulting p-values of a
document go through the step-up procedure at false-discovery rate ``FDR``: k tokens are reported if the
k-th smallest p-value is at most FDR * k / (tokens tested).

All work is row-local: no shuffle, no size at which anything changes. Null and empty texts have no spans;
repeated rows are judged alike; other columns pass through. Positions count code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgscreen.functions.bind import bind

KINDS = ("assign", "access", "hex", "random")
#: The shapes of the base kinds. A hex or access run is maximal, so its least length may stand in
#: the pattern; a short assignment is dropped after matching, because it still uses up its characters.
ASSIGN = (
    r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
MIN_VALUE = 8
MIN_TOKEN = 20
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"

FDR = 0.01
REJECT_Z = 4.0
#: What words of prose give: chance that two characters are equal, rate of changes of the character class,
#: lag-1 correlation in a mixed alphabet.
PROSE_COLLISION, PROSE_CHANGES, PROSE_CORRELATION = 0.075, 0.10, 0.5

DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Inferred encodings, narrowest first: characters allowed, alphabet in order.
ENCODINGS = [
    ("^[0-9]+$", DIGITS),
    ("^[0-9a-f]+$", DIGITS + "abcdef"),
    ("^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("^[a-z]+$", LOWER),
    ("^[A-Z2-7]+$", UPPER + "234567"),
    ("^[0-9a-z]+$", DIGITS + LOWER),
    ("^[0-9A-Z]+$", DIGITS + UPPER),
    ("^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
]
EVERY = UPPER + LOWER + DIGITS + "+/-_="


def change_rate(alphabet: str) -> float:
    """Chance that two symbols drawn uniformly differ in class: lower case, upper case, digit, other."""
    classes = [sum(c in group for c in alphabet) for group in (LOWER, UPPER, DIGITS)]
    classes.append(len(alphabet) - sum(classes))
    return 1 - sum((n / len(alphabet)) ** 2 for n in classes)

SPAN = "array<struct<start:bigint,kind:int,stop:bigint>>"


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans of all matches: the pieces between the matches give the positions."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if keep else found
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("match"), value.alias("value"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["match"]), F.lit(0))
        kept = x["match"].isNotNull() & (keep(x["value"]) if keep else F.lit(True))
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("stop"))
        return F.struct(end.alias("at"), F.when(kept, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate(pairs, start, step, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def tail(z: Column) -> Column:
    """Upper tail of the normal distribution (logistic approximation, within 2e-4; tiny but positive far out)."""
    return bind(F.greatest(F.least(z, F.lit(12.0)), F.lit(-12.0)), lambda z: 1.0 / (1.0 + F.exp(1.5976 * z + 0.07056 * z * z * z)))


def battery(token: Column) -> Column:
    """Struct of a token: alphabet size, chi2, changes, correlation, random, p (chance of prose looking so)."""
    # Each value that is used more than once is bound: written out at every use, the plan would grow by their product.
    def encoding(body: Column) -> Column:
        alphabet = F.lit(EVERY)
        for pattern, letters in reversed(ENCODINGS):
            alphabet = F.when(body.rlike(pattern), F.lit(letters)).otherwise(alphabet)
        return F.struct(body.alias("body"), alphabet.alias("alphabet"))

    def based(t: Column) -> Column:
        rates = F.lit(change_rate(EVERY))
        for letters in {letters for _, letters in ENCODINGS}:
            rates = F.when(t["alphabet"] == letters, F.lit(change_rate(letters))).otherwise(rates)
        n, size = (F.length(t[c]).cast("double") for c in ("body", "alphabet"))
        return F.struct(t["body"].alias("body"), n.alias("n"), t["alphabet"].alias("alphabet"), size.alias("size"), rates.alias("rate"))

    base = bind(bind(F.regexp_replace(token, "=+$", ""), encoding), based)

    def counted(t: Column) -> Column:
        squares = F.aggregate(
            F.filter(F.split(t["alphabet"], ""), lambda c: c != ""), F.lit(0.0),
            lambda acc, c: acc + F.pow((F.length(t["body"]) - F.length(F.replace(t["body"], c))).cast("double"), F.lit(2.0)),
        )
        letters = F.filter(F.split(t["body"], ""), lambda c: c != "")
        places = F.transform(letters, lambda c: F.instr(t["alphabet"], c).cast("double"))
        # Class along the token as one string: lower case a, upper case A, digit 0, anything else -.
        shape = F.translate(t["body"], LOWER[1:] + UPPER[1:] + DIGITS[1:] + "+/_=", "a" * 25 + "A" * 25 + "0" * 9 + "----")
        changes = F.length(F.regexp_replace(shape, r"(.)\1*", "x")) - 1
        return F.struct(
            t["n"].alias("n"), t["size"].alias("size"), t["rate"].alias("rate"), (t["size"] / t["n"] * squares - t["n"]).alias("chi2"),
            changes.cast("double").alias("changes"), places.alias("places"),
        )

    # The mean is a field before it is used for each symbol: as an expression there it would be summed anew for each.
    def averaged(t: Column) -> Column:
        mean = F.aggregate(t["places"], F.lit(0.0), lambda a, x: a + x) / t["n"]
        return F.struct(*[t[c].alias(c) for c in ("n", "size", "rate", "chi2", "changes", "places")], mean.alias("mean"))

    def correlated(t: Column) -> Column:
        mean = t["mean"]
        spread = F.aggregate(t["places"], F.lit(0.0), lambda a, x: a + x * x) - t["n"] * mean * mean
        count = F.greatest(F.size(t["places"]) - 1, F.lit(0))
        both = F.zip_with(F.slice(t["places"], F.lit(1), count), F.slice(t["places"], F.lit(2), count), lambda x, y: (x - mean) * (y - mean))
        r = F.when(spread > 1e-9, F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / spread).otherwise(F.lit(1.0))
        return F.struct(*[t[c].alias(c) for c in ("n", "size", "rate", "chi2", "changes")], r.alias("correlation"))

    def judged(t: Column) -> Column:
        n, size = t["n"], t["size"]
        free = size - 1
        uniform = (F.pow(t["chi2"] / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        rate = t["rate"]
        runs = (t["changes"] - (n - 1) * rate) / F.sqrt((n - 1) * F.greatest(rate * (1 - rate), F.lit(0.05)))
        prose_chi2 = free + (n - 1) * (size * PROSE_COLLISION - 1)
        z1 = (prose_chi2 - t["chi2"]) / (size * F.sqrt((n - 1) / n * 2 * PROSE_COLLISION))
        z2 = (t["changes"] - (n - 1) * PROSE_CHANGES) / F.sqrt((n - 1) * PROSE_CHANGES * (1 - PROSE_CHANGES))
        z3 = (PROSE_CORRELATION - t["correlation"]) * F.sqrt(n)
        p = tail(F.when(rate > 0, (z1 + z2 + z3) / F.sqrt(F.lit(3.0))).otherwise(z1))
        random = (n >= MIN_TOKEN) & (uniform <= REJECT_Z) & (F.abs(runs) <= REJECT_Z)
        return F.struct(*[t[c].alias(c) for c in ("size", "chi2", "changes", "correlation")], random.alias("random"), p.alias("p"))

    one = F.transform(F.array(base), lambda t: F.when((t["n"] >= 2) & (t["alphabet"] != DIGITS), counted(t)))
    two = F.transform(F.transform(F.filter(one, lambda t: t.isNotNull()), averaged), correlated)
    return F.get(F.transform(two, judged), F.lit(0))


def discoveries(tokens: Column) -> Column:
    """Spans of the random tokens that pass the step-up procedure among all tokens of the text."""

    def last(below: Column) -> Column:
        return F.when(F.size(below) > 0, F.coalesce(F.element_at(below, -1), F.lit(-1.0))).otherwise(F.lit(-1.0))

    def passed(tested: Column) -> Column:
        random = F.array_sort(F.transform(F.filter(tested, lambda t: t["test"]["random"]), lambda t: t["test"]["p"]))
        below = F.filter(random, lambda p, i: p <= FDR * (i + 1) / F.size(tested))
        kept = lambda limit: F.filter(tested, lambda t: t["test"]["random"] & (t["test"]["p"] <= limit))
        return F.transform(bind(bind(below, last), kept), lambda t: t["span"])

    # Bound, lest the battery be planned and run again for each use of its outcome.
    return bind(F.filter(tokens, lambda t: t["test"].isNotNull()), passed)


def scanned(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with a struct ``out``: base spans and all spans, each ordered by start, then kind."""
    given = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(SPAN)
    base = F.concat(
        _spans(given, ASSIGN, 0, keep=lambda value: F.length(value) >= MIN_VALUE), _spans(given, ACCESS, 1), _spans(given, HEX, 2)
    )
    token_spans = _spans(given, TOKEN, 3)
    step = docs.withColumn(out, F.struct(F.array_sort(base).alias("base"), token_spans.alias("tokens")))
    tested = F.transform(
        F.col(f"{out}.tokens"),
        lambda s: F.struct(s.alias("span"), battery(F.substring(given, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))).alias("test")),
    )
    more = F.when(F.size(f"{out}.tokens") > 0, discoveries(tested)).otherwise(none)
    step = step.withColumn(out, F.struct(F.col(f"{out}.base").alias("base"), more.alias("more")))
    return step.withColumn(
        out,
        F.struct(F.col(f"{out}.base").alias("base"), F.array_sort(F.concat(F.col(f"{out}.base"), F.col(f"{out}.more"))).alias("spans")),
    )


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def masked(docs: DataFrame, text: str = "text", secrets: str = "secrets", mark: str = "[SECRET]") -> DataFrame:
    """Texts with every secret span (overlapping ones as one) replaced by ``mark``; null stays null."""
    source = F.col(text)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(source, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        fresh = (s["start"] >= acc["at"]) & ((s["start"] > acc["at"]) | (acc["at"] == 0) | ~acc["kept"].endswith(mark))
        return F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"),
            F.when(fresh, F.concat(acc["kept"], before, F.lit(mark))).otherwise(acc["kept"]).alias("kept"),
        )

    def rest(acc: Column) -> Column:
        return F.concat(acc["kept"], F.substring(source, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1)))

    clean = F.aggregate(F.col(f"{secrets}.spans"), start, step, rest)
    return docs.withColumn(text, F.when(source.isNotNull() & (F.size(f"{secrets}.spans") > 0), clean).otherwise(source))
