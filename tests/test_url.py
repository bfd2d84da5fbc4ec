import random
from urllib.parse import urlparse

from pyspark.sql import functions as F

from msgscreen.functions import lexicons, url

GOLDEN = [
    ("http://paypal-secure-login.xyz/verify/account", "paypal-secure-login.xyz", "", "/verify/account", "http", 45, 0, 0, 2, 0, 0, 1, "verify,secure,login,account,paypal"),
    ("https://www.google.com", "www.google.com", "www", "", "https", 22, 0, 0, 0, 1, 1, 0, ""),
    ("http://192.168.1.1/login?user=admin", "192.168.1.1", "192.168", "/login", "http", 35, 1, 0, 0, 2, 0, 0, "login"),
    ("https://amazon-update-account.tk/confirm", "amazon-update-account.tk", "", "/confirm", "https", 40, 0, 0, 2, 0, 1, 1, "account,update,confirm,amazon"),
    ("https://visacru.gu.cc/home.html", "visacru.gu.cc", "visacru", "/home.html", "https", 31, 0, 0, 0, 1, 1, 0, ""),
    ("https://tiny1.org/1v", "tiny1.org", "", "/1v", "https", 20, 0, 0, 0, 0, 1, 0, ""),
    ("https://paypa1-secure-login.verify-account.xyz/confirm?user=victim&token=abc123", "paypa1-secure-login.verify-account.xyz", "paypa1-secure-login", "/confirm", "https", 79, 0, 0, 3, 1, 1, 1, "verify,secure,login,account,confirm"),
    ("www.a-b.xyz/p", "", "", "www.a-b.xyz/p", "", 13, 0, 0, 0, 0, 0, 0, ""),
    ("http://192.168.1.1:8080/x", "192.168.1.1:8080", "192.168", "/x", "http", 25, 0, 0, 0, 2, 0, 0, ""),
    ("HTTPS://User@Ex_ample.COM/a;p=1?q#f", "User@Ex_ample.COM", "", "/a", "https", 35, 0, 1, 0, 0, 1, 0, ""),
    ("http://ex.com/urgent-verification", "ex.com", "", "/urgent-verification", "http", 33, 0, 0, 0, 0, 0, 0, "verification,urgent,verification,urgent"),
]


def test_golden_features(spark):
    df = spark.createDataFrame([(r[0],) for r in GOLDEN], "u string").withColumn("f", url.url_features(F.col("u")))
    got = {r.u: r.f for r in df.collect()}
    for u, domain, sub, path, scheme, length, ip, at, dash, subs, https, tld, words in GOLDEN:
        f = got[u]
        assert (f.domain, f.subdomain, f.path, f.scheme, f.url_length) == (domain, sub, path, scheme, length)
        assert (f.has_ip, f.has_at, f.dash_count, f.subdomain_count) == (bool(ip), bool(at), dash, subs)
        assert (f.is_https, f.suspicious_tld, ",".join(f.suspicious_words)) == (bool(https), bool(tld), words)


def test_split_like_urllib(spark):
    rng = random.Random(3)
    parts = ["http", "https", "ftp", "a.b", "x+y", "1a", "://", ":", "//", "/", ";", "?", "#", "@", "p=1", "ex.com", "é.fr", "a b", "\t", "\n", " ", ".", "-"]
    urls = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(urls)), "id int, u string")
    cols = url.url_parts(F.col("u"))
    for row in df.select("id", *[c.alias(n) for n, c in cols.items()]).collect():
        p = urlparse(urls[row.id])
        assert (row.scheme, row.domain, row.path) == (p.scheme, p.netloc, p.path), repr(urls[row.id])


def test_detection(spark):
    yes = ["http://x", "https://x", "www.x", "paypal.xyz", "hello.there you", "été.fr", "  www.x "]
    no = ["ftp://x.com", "hello there", "a.B", "HTTP://x.com", "é.fr", ""]
    df = spark.createDataFrame([(t,) for t in yes + no], "t string")
    got = {r.t: r.v for r in df.select("t", url.is_url(F.col("t")).alias("v")).collect()}
    assert [got[t] for t in yes] == [True] * len(yes)
    assert [got[t] for t in no] == [False] * len(no)
    strict = {r.t: r.v for r in df.select("t", url.is_url(F.col("t"), strict=True).alias("v")).collect()}
    assert not strict["hello.there you"] and strict["paypal.xyz"] and strict["été.fr"]


def test_options_and_lists(spark):
    df = spark.createDataFrame([("www.a-b.xyz/urgent-verification",)], "u string")
    row = df.select(url.url_features(F.col("u"), assume_scheme=True, distinct_words=True).alias("f")).first().f
    assert (row.domain, row.dash_count, row.suspicious_tld) == ("www.a-b.xyz", 1, True)
    assert row.suspicious_words == ["verification", "urgent"]
    assert (len(lexicons.WORDS), len(set(lexicons.WORDS)), len(lexicons.TLDS)) == (114, 112, 26)
    assert (len(lexicons.SMALL_WORDS), len(lexicons.SMALL_TLDS)) == (20, 8)


def test_feature_text(spark):
    df = spark.createDataFrame([("https://www.google.com",)], "u string")
    f = url.url_features(F.col("u"))
    row = df.select(url.features_to_text(f).alias("en"), url.features_to_text(f, "fr").alias("fr")).first()
    assert row.en.split("\n") == [
        "URL analyzed: https://www.google.com", "Domain: www.google.com", "Subdomain: www", "Path: /", "Protocol: HTTPS",
        "Total length: 22 characters", "Contains IP address: no", "Contains @: no", "Dashes in domain: 0",
        "Number of subdomains: 1", "HTTPS: yes", "Suspicious TLD: no", "Suspicious words detected: none",
    ]
    assert row.fr.split("\n")[-1] == "Mots suspects détectés : aucun"
