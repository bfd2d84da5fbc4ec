"""URL detection, splitting and risk features as built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from msgscreen.functions import lexicons
from msgscreen.functions.bind import bind
from msgscreen.functions.text import strip

# Letters, numbers and underscore: what Python's \w covers.
_HOST_START = r"^[\p{L}\p{N}_\-]+\.[a-z]{2,}"
_WHOLE_HOST = r"^[\p{L}\p{N}_\-]+(?:\.[\p{L}\p{N}_\-]+)*\.[a-z]{2,}(?::\p{Nd}+)?(?:[/?#]\S*)?$"

# RFC 3986 components: scheme, authority, path.
_SPLIT = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"
_IPV4 = r"^\p{Nd}{1,3}(?:\.\p{Nd}{1,3}){3}$"
_CONTROLS = "".join(chr(i) for i in range(0x21))


def is_url(text: Column, strict: bool = False) -> Column:
    """True for http(s):// and www. prefixes and for text that begins like a host name.

    The default accepts any text after the host (``hello.there you``); ``strict``
    wants the whole text to be one host with an optional path.
    """
    value = strip(text)
    host = value.rlike(_WHOLE_HOST if strict else _HOST_START)
    return value.startswith("http://") | value.startswith("https://") | value.startswith("www.") | host


def url_parts(url: Column, assume_scheme: bool = False) -> dict[str, Column]:
    """``scheme``, ``domain`` (with port and user), ``path`` (without ``;params``)."""
    cleaned = F.translate(F.ltrim(url, F.lit(_CONTROLS)), "\t\r\n", "")
    if assume_scheme:
        cleaned = F.when(cleaned.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"), cleaned).otherwise(
            F.concat(F.lit("http://"), cleaned)
        )
    scheme = F.lower(F.regexp_extract(cleaned, _SPLIT, 1))
    path = F.regexp_extract(cleaned, _SPLIT, 3)
    path = F.when(
        scheme.isin(lexicons.PARAM_SCHEMES), F.regexp_replace(path, r";[^/]*$", "")
    ).otherwise(path)
    return {"scheme": scheme, "domain": F.regexp_extract(cleaned, _SPLIT, 2), "path": path}


def lexicon_hits(url: Column, words: Sequence[str] = lexicons.WORDS, distinct: bool = False) -> Column:
    """Lexicon entries contained in the lower-cased URL, in lexicon order."""
    entries = list(dict.fromkeys(words)) if distinct else list(words)
    lexicon = F.split(F.lit("\n".join(entries)), "\n")  # folds to one constant array
    return bind(F.lower(url), lambda low: F.filter(lexicon, lambda word: F.contains(low, word)))


def url_features(
    url: Column,
    words: Sequence[str] = lexicons.WORDS,
    tlds: Sequence[str] = lexicons.TLDS,
    *,
    assume_scheme: bool = False,
    distinct_words: bool = False,
) -> Column:
    """Struct of 13 features of a URL."""
    parts = url_parts(url, assume_scheme)
    pieces = F.struct(*[parts[name].alias(name) for name in ("scheme", "domain", "path")])

    def features(piece: Column) -> Column:
        domain, scheme = piece["domain"], piece["scheme"]
        return bind(F.split(domain, r"\."), lambda labels: struct(piece, domain, scheme, labels))

    def struct(piece: Column, domain: Column, scheme: Column, labels: Column) -> Column:
        extra = F.greatest(F.size(labels) - 2, F.lit(0))
        return F.struct(
            url.alias("url"),
            domain.alias("domain"),
            F.array_join(F.slice(labels, F.lit(1), extra), ".").alias("subdomain"),
            piece["path"].alias("path"),
            scheme.alias("scheme"),
            F.length(url).alias("url_length"),
            domain.rlike(_IPV4).alias("has_ip"),
            F.contains(url, F.lit("@")).alias("has_at"),
            (F.length(domain) - F.length(F.replace(domain, F.lit("-"), F.lit("")))).alias("dash_count"),
            extra.alias("subdomain_count"),
            (scheme == "https").alias("is_https"),
            F.concat(F.lit("."), F.element_at(labels, -1)).isin(list(tlds)).alias("suspicious_tld"),
            lexicon_hits(url, words, distinct_words).alias("suspicious_words"),
        )

    return bind(pieces, features)


def features_to_text(features: Column, lang: str = "en") -> Column:
    """The features as 13 labelled lines, in the wording of ``lang``."""
    return bind(features, lambda f: _feature_lines(f, lang))


def _feature_lines(features: Column, lang: str) -> Column:
    wording = lexicons.FEATURE_TEXT[lang]

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(wording[name]), value)

    def flag(name: str) -> Column:
        return line(name, F.when(features[name], wording["yes"]).otherwise(wording["no"]))

    def text_or(value: Column, default: str) -> Column:
        return F.when(value == "", F.lit(default)).otherwise(value)

    def number(name: str) -> Column:
        return features[name].cast("string")

    return F.concat_ws(
        "\n",
        line("url", features["url"]),
        line("domain", features["domain"]),
        line("subdomain", text_or(features["subdomain"], wording["none"])),
        line("path", text_or(features["path"], "/")),
        line("scheme", F.upper(features["scheme"])),
        line("url_length", F.concat(number("url_length"), F.lit(wording["url_length_unit"]))),
        flag("has_ip"),
        flag("has_at"),
        line("dash_count", number("dash_count")),
        line("subdomain_count", number("subdomain_count")),
        flag("is_https"),
        flag("suspicious_tld"),
        line(
            "suspicious_words",
            text_or(F.array_join(features["suspicious_words"], ", "), wording["none"]),
        ),
    )
