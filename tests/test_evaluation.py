from pyspark.sql import functions as F

from msgscreen.operators import class_eval, profile

# Counts behind published rates: model -> TP, FN, FP, TN and the rates themselves.
GOLDEN = {
    "llama70b": ((45, 5, 18, 32), (0.77, 0.7143, 0.9, 0.7965, 0.7356, 0.766)),
    "llama8b": ((48, 2, 27, 23), (0.71, 0.64, 0.96, 0.768, 0.6133, 0.6907)),
    "qwen32b": ((50, 0, 44, 6), (0.56, 0.5319, 1.0, 0.6944, 0.2143, 0.4544)),
}


def predictions(spark, extra=()):
    rows = []
    for model, ((tp, fn, fp, tn), _) in GOLDEN.items():
        for n, t, p in ((tp, "phishing", "phishing"), (fn, "phishing", "legitimate"), (fp, "legitimate", "phishing"), (tn, "legitimate", "legitimate")):
            rows += [(model, f" {t.upper()} ", p, 2.5, "en")] * n
    return spark.createDataFrame(rows + list(extra), "model string, true_label string, pred_label string, response_time double, language string")


def test_published_rates(spark):
    extra = [("llama8b", "phishing", "error", 9.0, "en"), ("broken", "phishing", "error", 9.0, "en")]
    got = {r.model: r for r in class_eval.summary(predictions(spark, extra)).collect()}
    assert set(got) == set(GOLDEN)
    for model, (_, rates) in GOLDEN.items():
        r = got[model]
        assert (r.accuracy, r.precision, r.recall, r.f1_phishing, r.f1_legitimate, r.f1_macro) == rates
        assert (r.avg_time, r.valid, r.errors) == (2.5, 100, 1 if model == "llama8b" else 0)


def test_macro_counts_foreign_true_labels(spark):
    rows = [("m", "spam", "phishing", 1.0, "en"), ("m", "phishing", "phishing", 1.0, "en")]
    df = spark.createDataFrame(rows, "model string, true_label string, pred_label string, response_time double, language string")
    row = class_eval.summary(df).first()
    macro = {r["class"]: r.f1 for r in class_eval.report(df).collect()}["macro avg"]
    assert row.f1_macro == round(macro, 4) == 0.3333


def test_confusion_and_crosstab(spark):
    df = predictions(spark)
    cells = {(r.true_label, r.pred_label): r.n for r in class_eval.confusion_matrix(df).where("model = 'qwen32b'").collect()}
    assert cells == {("phishing", "phishing"): 50, ("phishing", "legitimate"): 0, ("legitimate", "phishing"): 44, ("legitimate", "legitimate"): 6}
    row = class_eval.crosstab(df).where("model = 'llama70b'").first()
    assert (row.phishing, row.legitimate) == (63, 37)
    row = class_eval.crosstab(df, ["phishing", "legitimate", "unknown", "error"]).where("model = 'llama70b'").first()
    assert (row.phishing, row.legitimate, row.unknown, row.error) == (63, 37, 0, 0)
    fifth = df.unionByName(df.limit(1).withColumn("pred_label", F.lit("spam")).withColumn("model", F.lit("new")))
    row = class_eval.crosstab(fifth).where("model = 'new'").first()
    assert (row.spam, row.phishing, row.legitimate) == (1, 0, 0)
    report = {r["class"]: r for r in class_eval.report(df).where("model = 'llama70b'").collect()}
    assert report["accuracy"].f1 == 0.77 and report["weighted avg"].support == 100


def test_by_language(spark):
    right = {("ar", 30): 23, ("en", 55): 45, ("fr", 15): 9}
    rows = []
    for (lang, n), good in right.items():
        rows += [("m", "phishing", "phishing" if i < good else "legitimate", 1.0, lang) for i in range(n)]
    df = spark.createDataFrame(rows, "model string, true_label string, pred_label string, response_time double, language string")
    got = {r.language: (r.samples, r.accuracy) for r in class_eval.by_language(df).collect()}
    assert got == {"ar": (30, 0.7667), "en": (55, 0.8182), "fr": (15, 0.6)}


def test_profile_golden(spark):
    channels = {"email": 644, "sms": 856, "url": 1264, "social_media": 274}
    languages = {"en": 1508, "ar": 899, "fr": 631}
    attacks = {"none": 1041, "credential_theft": 739, "brand_impersonation": 609, "urgency": 368, "prize_scam": 185,
               "typosquatting": 24, "malware_link": 18, "malicious_attachment": 10, "threat": 4, None: 40}

    def column(counts):
        return [v for v, n in counts.items() for _ in range(n)]

    rows = list(zip(column({"phishing": 1359, "legitimate": 1679}), column(channels), column(languages), column(attacks)))
    df = spark.createDataFrame(rows, "label string, channel string, language string, attack_type string")
    got = {(r.dimension, r.value): r.n for r in profile.corpus_profile(df).collect()}
    want = {("total", "all"): 3038, ("label", "phishing"): 1359, ("label", "legitimate"): 1679}
    want |= {("channel", v): n for v, n in channels.items()} | {("language", v): n for v, n in languages.items()}
    want |= {("attack_type", v): n for v, n in attacks.items() if v}
    assert got == want
    empty = profile.corpus_profile(df.where("language = 'fr'").where(F.col("label") == "nothing"))
    assert {(r.dimension, r.value): r.n for r in empty.collect()}[("language", "ar")] == 0
    assert {r.language: r.n for r in profile.language_counts(df).collect()} == {"English": 1508, "Arabic": 899, "French": 631}
    assert [r.value for r in profile.count_by(df, "channel").collect()] == ["url", "sms", "email", "social_media"]
