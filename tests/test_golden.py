"""Small cases with known figures: accuracy, recall, F1, consistency, baseline, certainty, routing, bias, run 1, warm-up."""

import pytest
from pyspark.sql import functions as F

from tallymark.functions.labels import ANSWER, FIELDS
from tallymark.operators import metrics as m
from tallymark.operators import votes as v

A, B = ("now", "billing", True, False), ("later", "other", False, True)
TRUTH = f"id string, truth {ANSWER}"
LOG = f"seq long, dataset string, model string, id string, run int, answer {ANSWER}, error string, latency_ms double, tokens_in long, tokens_out long, cost_usd double, confidence map<string,double>, noul map<string,double>"


def logged(spark, model, answers, latency=10.0, cost=0.001, confidence=None, noul=None):
    rows = [(n, "real", model, i, run, a, None if a else "refusal: x", latency, 100, None, cost, confidence and confidence[i], noul and noul[i]) for n, ((i, run), a) in enumerate(answers.items())]
    return spark.createDataFrame(rows, LOG)


def only(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]


def test_accuracy_recall_and_f1(spark):
    told = [("now", "now"), ("later", "now"), ("later", "later"), ("soon", "later")]
    answers = logged(spark, "m", {(str(i), 1): (p, *A[1:]) for i, (p, _) in enumerate(told)})
    truth = spark.createDataFrame([(str(i), (t, *A[1:])) for i, (_, t) in enumerate(told)], TRUTH)
    p = m.pairs(answers, truth)
    of = lambda df: df.where("field = 'urgency'")
    assert only(of(m.field_accuracy(p))).accuracy == 0.5
    classes = m.class_recall_precision(p)
    assert {r["class"]: r.recall for r in of(classes).collect()} == {'"now"': 0.5, '"soon"': None, '"later"': 0.5}
    assert only(of(m.macro_f1(classes))).macro_f1 == pytest.approx((2 / 3 + 0.5) / 2, abs=1e-4)
    assert {(r.actual, r.pred): r.n for r in of(m.confusion_matrix(p)).collect()} == {('"now"', '"now"'): 1, ('"now"', '"later"'): 1, ('"later"', '"later"'): 1, ('"later"', '"soon"'): 1}


def test_quality_consistency_latency_and_cost(spark):
    truth = spark.createDataFrame([("1", A), ("2", B), ("3", (B[0], None, *B[2:]))], TRUTH)
    log = logged(spark, "m", {("1", 1): A, ("1", 2): A, ("2", 1): B, ("2", 2): A, ("3", 1): None})
    answers = v.latest_answers(log, ["dataset", "model", "id", "run"])
    assert tuple(only(m.call_errors(log)))[2:] == (5, 1)
    assert [tuple(r) for r in v.error_kinds(log, ["model"]).collect()] == [("m", "refusal", 1)]
    flags = m.message_flags(m.pairs(answers, truth))
    assert tuple(only(m.all_fields_correct(flags)))[2:] == (4, 0.75)
    assert only(m.run_consistency(answers).where("field = 'all'")).consistency == 0.5
    assert tuple(only(m.latency_stats(log)))[2:] == (10.0, 10.0, 10.0)
    assert only(m.cost_per_1000(log)).cost_per_1000 == 1.0
    assert tuple(only(m.token_means(log)))[2:] == (100.0, 0.0)


def test_baseline(spark):
    truth = spark.createDataFrame([(str(i), B) for i in range(9)] + [("x", A)], TRUTH)
    assert {r.field: r.baseline for r in m.majority_baseline(truth).collect()} == {f.name: 0.9 for f in FIELDS}


@pytest.mark.parametrize(("confidence", "noul", "want"), [({"a": 0.9, "b": 0.7}, {"c": 0.95, "d": 0.6}, 0.2), ({}, {}, 0.0), (None, None, 0.0), ({"a": 0.3}, None, 0.3), (None, {"c": 0.0}, 1.0)])
def test_certainty(spark, confidence, noul, want):
    df = spark.createDataFrame([(confidence, noul)], "c map<string,double>, n map<string,double>")
    assert df.select(m.certainty("c", "n")).first()[0] == pytest.approx(want)


def test_routing_escalates_what_is_uncertain(spark):
    truth = spark.createDataFrame([("1", A), ("2", B)], TRUTH)
    sure = {"1": {"d": 1.0}, "2": {"d": 0.3}}
    first = m.first_runs(logged(spark, "p", {("1", 1): A, ("2", 1): A}, 5.0, 0.0, sure, {"1": {"x": 1.0}, "2": {"x": 1.0}}), "p")
    second = m.first_runs(logged(spark, "f", {("1", 1): B, ("2", 1): B}, 100.0, 0.01), "f").drop("certainty")
    got = {r.threshold: r for r in m.hybrid_sweep(first, second, truth, (0.0, 0.5, 1.01)).collect()}
    assert {t: (r.escalated, r.acc_all) for t, r in got.items()} == {0.0: (0.0, 0.5), 0.5: (0.5, 1.0), 1.01: (1.0, 0.5)}
    assert got[0.5].latency_mean == 55.0 and got[0.5].cost_per_1000 == 5.0


def test_bias_and_intent(spark):
    truth = spark.createDataFrame([("1", A), ("2", B)], TRUTH)
    flags = m.message_flags(m.pairs(logged(spark, "m", {("1", 1): A, ("2", 1): A}), truth))
    generators = spark.createDataFrame([("1", "g"), ("2", "h")], "id string, generator string")
    got = {r.generator: (r.n, r.all_correct, r.family) for r in m.generator_bias(flags, generators, {"g": "one"}).collect()}
    assert got == {"g": (1, 1.0, "one"), "h": (1, 0.0, None)}
    intents = spark.createDataFrame([("1", A), ("2", ("now", *B[1:]))], f"id string, intent {ANSWER}")
    assert {r.field: r.agreement for r in m.intent_agreement(intents, truth).collect()} == {"urgency": 0.5, "category": 1.0, "reply_needed": 1.0, "phishing": 1.0}


def test_significance_takes_run_1_only(spark):
    truth = spark.createDataFrame([("1", A), ("2", B)], TRUTH)
    log = logged(spark, "x", {("1", 1): A, ("2", 1): A, ("2", 2): B}).unionByName(logged(spark, "y", {("1", 1): B, ("2", 1): A, ("1", 2): A}))
    flags = m.message_flags(m.pairs(log, truth))
    assert {r.model: (r.k, r.n) for r in m.significance_run1(flags).collect()} == {"x": (1, 2), "y": (0, 2)}
    assert tuple(only(m.mcnemar_pairs(flags)))[1:] == ("x", "y", 1, 0, 1.0)


def test_warmup_is_paid_for_but_not_logged(spark):
    models, ids, runs = spark.createDataFrame([("m1",), ("m2",)], "model string"), spark.createDataFrame([("1",), ("2",)], "id string"), spark.createDataFrame([(1,)], "run int")
    done = logged(spark, "m2", {("1", 1): A, ("2", 1): B})
    todo = v.pending_work(models, ids, done, runs)
    warm = v.warmup_calls(todo, 2)
    assert sorted(map(tuple, warm.collect())) == [("m1", "warmup", 1), ("m1", "warmup", 2)]
    assert v.warmup_calls(todo, 0).count() == 0 and v.warmup_calls(todo.limit(0), 2).count() == 0
    calls = warm.select("model", "id", F.lit(0.5).alias("cost_usd")).unionByName(todo.select("model", "id", F.lit(1.0).alias("cost_usd")))
    assert sorted(r.id for r in v.without_warmup(calls).collect()) == ["1", "2"]
    assert [tuple(r) for r in v.spent(calls).collect()] == [("m1", 3.0)]
