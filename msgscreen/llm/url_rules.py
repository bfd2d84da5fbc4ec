"""URL filters: pattern rules found through their rarest literal token. DataFrame functions only.

A rule is (verdict, pattern). In a pattern ``||`` at the front anchors at a host and its subdomains, ``|`` at
either end anchors there, ``*`` stands for anything and ``^`` for a separator (anything but a letter, digit,
``_``, ``-``, ``%``; or the start or end). A pattern is matched against host and path joined, with the query string.

Tokens are runs of lower-cased letters and digits. A literal token of a rule counts only if the pattern
fixes both its neighbours, so that every matching URL has it as a token of its own. Each rule is filed
under the one of its tokens that occurs in the fewest URLs (counted over the whole table); a rule without
a token is filed under the empty token, which every URL has. A URL runs the regular expressions of the
rules under its own tokens and no others. Of the matching rules the longest wins, then the longer host,
then the lower pattern.

The rules are a list given by the caller, held in the plan as a literal map of at most ``MAX_RULES`` rules;
URLs are never shuffled: the only exchange is the count of rule tokens. Nulls and URLs without ``://`` have
an empty host and path and match only what an empty string matches. Repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 2_000
SEPARATOR = r"[^A-Za-z0-9_%\-]"

HOST_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Rules of the method beyond the host rules: pages that are no prose, adult and gambling hosts, binaries.
PATTERN_RULES = [
    ("block", "/login^"), ("block", "/signup^"), ("block", "/cart^"), ("block", "/checkout^"), ("block", "/wp-login.php"),
    ("block", "/cgi-bin/"), ("block", "||doubleclick.net^"), ("block", "||xxx/"), ("block", "^casino^"), ("block", "^porn^"),
    ("block", "^torrent^"), ("block", ".exe|"), ("block", ".zip|"), ("block", ".apk|"), ("block", "^sessionid^"),
    ("block", "^print^1|"), ("allow", "||wikipedia.org/wiki/"),
]


def lowered(text: Column) -> Column:
    """A-Z only: other letters must not turn into letters that rules are written in."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return lowered(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _query_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)?", 1)


def tokens_of(text: Column) -> Column:
    """Distinct tokens, and the empty token under which rules without a literal token are filed."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(lowered(text), "[^a-z0-9]+")))


def rule_regex(pattern: Column) -> Column:
    """Java regular expression of a pattern."""
    body = F.regexp_replace(pattern, r"^\|\|?|^\^|\|$", "")
    body = F.regexp_replace(body, r"([\\.+?()\[\]{}$|/-])", r"\\$1")
    body = F.replace(F.replace(body, F.lit("^"), F.lit(rf"(?:{SEPARATOR}|\z)")), F.lit("*"), F.lit(".*"))
    front = (
        F.when(pattern.startswith("||"), r"^(?:[^/?]*\.)?").when(pattern.startswith("|"), "^")
        .when(pattern.startswith("^"), rf"(?:^|{SEPARATOR})").otherwise("")
    )
    back = F.when(pattern.rlike(r"[^|]\|$"), r"\z").otherwise("")
    return F.concat(F.lit("(?s)"), front, body, back)


def rule_tokens(pattern: Column) -> Column:
    """Literal tokens whose two neighbours the pattern fixes."""
    lower = lowered(pattern)
    fixed = F.concat(
        F.when(lower.startswith("|"), "/").otherwise("*"), F.regexp_replace(lower, r"^\|\|?|\|$", ""),
        F.when(lower.endswith("|"), "/").otherwise("*"),
    )
    # A run next to "*" may be a part of a longer token: it is taken out before cutting.
    safe = F.regexp_replace(fixed, r"(?<=\*)[a-z0-9]+|[a-z0-9]+(?=\*)", "")
    return F.filter(F.split(safe, "[^a-z0-9]+"), lambda t: t != "")


def rules_frame(spark, host_rules=None, pattern_rules=None) -> DataFrame:
    """One row a rule: verdict, rule as written, whether it is a host rule, regular expression, tokens."""
    host = [(v, r, True, f"||{r}") for v, r in (HOST_RULES if host_rules is None else host_rules)]
    other = [(v, p, False, p) for v, p in (PATTERN_RULES if pattern_rules is None else pattern_rules)]
    if len(host) + len(other) > MAX_RULES:
        raise ValueError(f"{len(host) + len(other)} rules; at most {MAX_RULES} fit into the plan")
    rows = spark.createDataFrame([*host, *other], "verdict string, rule string, is_host boolean, pattern string")
    rows = rows.dropDuplicates(["rule", "is_host"])
    return rows.withColumn("regex", rule_regex(F.col("pattern"))).withColumn("tokens", rule_tokens(F.col("pattern")))


def judged(
    pages: DataFrame, url: str = "url", host_rules=None, pattern_rules=None, default: str = "allow", out: str = "judged"
) -> DataFrame:
    """``pages`` with a struct ``out``: host, path, winning host rule, winning pattern rule, verdict."""
    spark = pages.sparkSession
    rules = rules_frame(spark, host_rules, pattern_rules).collect()  # the caller's own list back
    wanted = sorted({t for r in rules for t in r["tokens"]})
    given = F.col(url)
    matched = F.concat(host_of(given), path_of(given), F.coalesce(_query_of(given), F.lit("")))
    counts = {}
    if wanted:
        seen = pages.select(F.explode(F.array_intersect(tokens_of(matched), F.array(*[F.lit(t) for t in wanted]))).alias("t"))
        counts = {r["t"]: r["n"] for r in seen.groupBy("t").agg(F.count("*").alias("n")).collect()}
    filed: dict[str, list] = {}
    for r in rules:
        rarest = min(r["tokens"], key=lambda t: (counts.get(t, 0), t), default="")
        filed.setdefault(rarest, []).append(r)
    entry = lambda r: F.struct(
        F.lit(r["rule"]).alias("rule"), F.lit(r["regex"]).alias("regex"), F.lit(r["verdict"]).alias("verdict"),
        F.lit(r["is_host"]).alias("is_host"), F.lit(len(r["rule"].partition("/")[0])).alias("host_size"),
    )
    step = pages.withColumn(out, F.struct(host_of(given).alias("host"), path_of(given).alias("path"), matched.alias("matched")))
    if not filed:
        none = F.lit(None).cast("string")
        found = F.struct(F.col(f"{out}.host"), F.col(f"{out}.path"), none.alias("rule"), none.alias("pattern"), F.lit(default).alias("verdict"))
        return step.withColumn(out, found)
    index = F.create_map(*[x for t, rs in sorted(filed.items()) for x in (F.lit(t), F.array(*[entry(r) for r in rs]))])
    text = F.col(f"{out}.matched")
    here = F.filter(tokens_of(text), lambda t: F.array_contains(F.array(*[F.lit(t) for t in sorted(filed)]), t))
    candidates = F.flatten(F.transform(here, lambda t: F.element_at(index, t)))
    matching = F.filter(candidates, lambda r: F.call_function("rlike", text, r["regex"]))
    order = lambda a, b: (  # noqa: E731  the longest first, then the longer host, then the lower pattern
        F.when(F.length(a["rule"]) != F.length(b["rule"]), F.length(b["rule"]) - F.length(a["rule"]))
        .when(a["host_size"] != b["host_size"], b["host_size"] - a["host_size"])
        .when(a["rule"] < b["rule"], -1).when(a["rule"] > b["rule"], 1).otherwise(0)
    )
    best = F.array_sort(matching, order)
    step = step.withColumn(out, F.struct(F.col(f"{out}.host"), F.col(f"{out}.path"), best.alias("hits")))
    hits = F.col(f"{out}.hits")
    host_rule = F.get(F.filter(hits, lambda r: r["is_host"]), F.lit(0))
    pattern_rule = F.get(F.filter(hits, lambda r: ~r["is_host"]), F.lit(0))
    found = F.struct(
        F.col(f"{out}.host").alias("host"), F.col(f"{out}.path").alias("path"), host_rule["rule"].alias("rule"),
        pattern_rule["rule"].alias("pattern"), F.coalesce(host_rule["verdict"], pattern_rule["verdict"], F.lit(default)).alias("verdict"),
    )
    return step.withColumn(out, found)
