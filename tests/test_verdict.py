import random

from pyspark.sql import functions as F

from msgscreen.functions import verdict

CASES = [
    (1, '<think>{"label":"x"}</think>\n```json\n{"label":"Phishing","confidence":"high","risk_score":85}\n```', "phishing", "phishing", 0.9, 90, 85, "critical"),
    (2, 'Sure: {"label":"legit","confidence":1.7,"risk_score":"12"} ok', "legitimate", "unknown", 1.0, 100, 12, "low"),
    (3, '{"confidence":0.29,"risk_score":"75.9"}', "legitimate", "unknown", 0.29, 28, 0, "low"),
    (4, '{"label":"phishing","risk_score":40}', "phishing", "phishing", 0.0, 0, 40, "medium"),
    (5, "no json here", "error", "error", 0.0, 0, 0, "low"),
    (6, None, "error", "error", 0.0, 0, 0, "low"),
    (7, "", "error", "error", 0.0, 0, 0, "low"),
    (8, '{"label":"phishing","label":"legitimate"}', "error", "error", 0.0, 0, 0, "low"),
    (9, '{"label":"\'Legitimate\'","confidence":"0.8","risk_score":75.9}', "legitimate", "legitimate", 0.0, 0, 75, "critical"),
    (10, '{"label":"legitimate","confidence":true,"risk_score":null}', "legitimate", "legitimate", 1.0, 100, 0, "low"),
]


def test_cases(spark):
    df = spark.createDataFrame([(c[0], c[1]) for c in CASES], "id int, raw string")
    two = {r.id: r for r in verdict.normalise_verdicts(df, labels="two").collect()}
    three = {r.id: r for r in verdict.normalise_verdicts(df).collect()}
    for i, _, label2, label3, confidence, percent, risk, band in CASES:
        assert (two[i].label, three[i].label) == (label2, label3), i
        row = three[i]
        assert (row.confidence, row.confidence_pct, row.risk_score, row.risk_level) == (confidence, percent, risk, band), i
    assert three[5].error_type == "no_json" and three[8].error_type == "json_parse"
    assert not three[9].risk_consistent and three[10].risk_consistent
    assert three[5].suspicious_elements == [] and three[5].recommendations == "Please try again."
    fallback = {r.id: r for r in verdict.normalise_verdicts(df, mode="fallback").collect()}
    assert fallback[5].error_type == "json_parse"


def test_fallback_of_other_json(spark):
    df = spark.createDataFrame([(1, '"phishing"'), (2, "[1]")], "id int, raw string")
    assert {r.error_type for r in verdict.normalise_verdicts(df, mode="fallback").collect()} == {"not_an_object"}


def test_unknown_model(spark):
    df = spark.createDataFrame([("m1", '{"label":"phishing"}'), ("m9", '{"label":"phishing"}')], "model string, raw string")
    got = {r.model: (r.label, r.error_type) for r in verdict.normalise_verdicts(df, models=["m1"]).collect()}
    assert got == {"m1": ("phishing", None), "m9": ("error", "unknown_model")}


def test_rounding_is_pythons(spark):
    rng = random.Random(5)
    values = [i / 1000 for i in range(1001)] + [rng.random() for _ in range(3000)] + [0.0, 1.0, 1e-9, 0.004999, 0.005, 0.995]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", verdict.python_round2(F.col("v")).alias("r")).collect():
        assert row.r == round(row.v, 2), row.v


def test_greedy_and_list_text(spark):
    df = spark.createDataFrame([('<think>{a}</think> {"b":1} x',)], "raw string")
    row = df.select(verdict.extract_json(F.col("raw"), "greedy").alias("g"), verdict.extract_json(F.col("raw")).alias("f")).first()
    assert (row.g, row.f) == ('{a}</think> {"b":1}', '{"b":1}')
    items = spark.createDataFrame([(["a", "it's"],), ([],)], "v array<string>")
    assert [r[0] for r in items.select(verdict.quoted_list(F.col("v"))).collect()] == [str(["a", "it's"]), "[]"]


def test_long_scores_and_single_elements(spark):
    raw = [
        (1, '{"label":"phishing","risk_score":"1234567890123456789012345"}'), (2, '{"label":"phishing","risk_score":"-1234567890123456789012345"}'),
        (3, '{"label":"phishing","risk_score":"0000000000000000000000042","suspicious_elements":"one link"}'),
    ]
    rows = verdict.normalise_verdicts(spark.createDataFrame([(i, "m", r, 1.0) for i, r in raw], "query_id long, model string, raw string, seconds double"))
    got = {r.query_id: r for r in rows.collect()}
    assert [got[i].risk_level for i in (1, 2, 3)] == ["critical", "low", "medium"] and got[3].risk_score == 42
    assert got[3].suspicious_elements == ["one link"] and got[1].suspicious_elements == []
