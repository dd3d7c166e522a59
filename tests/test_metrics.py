import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.functions.quantiles import exact_quantiles
from tallymark.operators import metrics as m


@pytest.mark.parametrize(("a", "b", "want"), [(21, 20, 1.0), (39, 14, 0.0008), (10, 0, round(2 / 1024, 4)), (0, 0, 1.0), (50_000_000, 50_030_000, 0.0027)])
def test_mcnemar(spark, a, b, want):
    got = spark.createDataFrame([(a, b)], "a long, b long").select(m.mcnemar_p("a", "b")).first()[0]
    assert got == pytest.approx(want, abs=1e-4)


def test_wilson(spark):
    low, high = spark.range(1).select(*m.wilson_interval(F.lit(97), F.lit(150))).first()
    assert (round(low, 3), round(high, 3)) == (0.567, 0.719)


def test_exact_quantiles_of_large_and_odd_groups(spark):
    rng = np.random.default_rng(1)
    rows = [("d", "many", float(x)) for x in rng.normal(size=3001)] + [("d", "ties", float(i % 3)) for i in range(1000)] + [("d", "one", 5.0), ("e", "two", 1.0), ("e", "two", 2.0), ("e", "none", None)]
    df = spark.createDataFrame(rows, "dataset string, model string, v double")
    shares = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {(r.dataset, r.model): r.q for r in exact_quantiles(df, m.GROUP, "v", shares).collect()}
    want = {}
    for d, n, x in rows:
        if x is not None:
            want.setdefault((d, n), []).append(x)
    assert got.keys() == want.keys()
    for k, x in want.items():
        assert np.allclose(got[k], np.quantile(x, shares), rtol=0, atol=1e-12)


def test_sweep_is_the_same_as_row_by_row(spark):
    rng = np.random.default_rng(2)
    answer = "struct<urgency:string,category:string,reply_needed:boolean,phishing:boolean>"
    pick = lambda: (["now", "soon", "later"][rng.integers(3)], "other", bool(rng.integers(2)), None if rng.random() < 0.1 else False)
    ids = [(str(i), ("ab"[i % 2])) for i in range(200)]
    a = {i: (pick(), float(rng.choice([0.0, 0.3, 0.55, 0.7, 1.0])), float(rng.random()), float(rng.random())) for i, _ in ids}
    b = {i: (pick(), float(rng.random()), float(rng.random())) for i, _ in ids[:150]}
    t = {i: ("now", "other", True, False if int(i) % 9 else None) for i, _ in ids}
    primary = spark.createDataFrame([(d, i, a[i][0], a[i][2], a[i][3], a[i][1]) for i, d in ids], f"dataset string, id string, answer {answer}, cost_usd double, latency_ms double, certainty double")
    fallback = spark.createDataFrame([(d, i, *b[i]) for i, d in ids if i in b], f"dataset string, id string, answer {answer}, cost_usd double, latency_ms double")
    truth = spark.createDataFrame([(i, x) for i, x in t.items()], f"id string, truth {answer}")
    got = {(r.dataset, r.threshold): r for r in m.hybrid_sweep(primary, fallback, truth, (0.7, 0.0, 0.3, 1.01)).collect()}
    for d in "ab":
        rows = [i for i, x in ids if x == d and i in b and None not in t[i]]
        for at in (0.0, 0.3, 0.7, 1.01):
            up = [i for i in rows if a[i][1] < at]
            used = {i: (b if i in up else a)[i][0] for i in rows}
            r = got[d, at]
            assert r.n == len(rows) and abs(r.escalated - len(up) / len(rows)) < 1e-4
            assert abs(r.acc_all - sum(used[i] == t[i] for i in rows) / len(rows)) < 1e-4 and abs(r.acc_phishing - sum(used[i][3] == t[i][3] for i in rows) / len(rows)) < 1e-4
            assert abs(r.latency_mean - sum(a[i][3] + (b[i][2] if i in up else 0) for i in rows) / len(rows)) < 0.06


def test_mcnemar_of_very_large_counts(spark):
    got = spark.createDataFrame([(21, 20), (39, 14), (10, 0), (10**9, 10**9 + 10**5), (10**15, 10**15 - 10**7)], "a long, b long").select(m.mcnemar_p("a", "b").alias("p")).collect()
    assert [r.p for r in got][:3] == [1.0, 0.0008, round(2 / 1024, 4)] and abs(got[3].p - 0.0253) < 2e-4 and 0.7 < got[4].p < 0.9


def test_report_counts_give_the_single_operators_tables(spark, tmp_path):
    from tallymark.jobs import fixtures as fx

    log = fx.decision_log(spark, "/root/testdata/sf0.001")
    m.pairs(fx.answers(log), fx.truth(log)).write.parquet(str(tmp_path / "p"))
    p = spark.read.parquet(str(tmp_path / "p"))
    counts = m.report_counts(p)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and plan.count("Expand") == 1
    confusion, flags = m.counted_confusion(counts), m.counted_flags(counts)
    same = lambda a, b: sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect())) and b.count() > 0
    assert same(confusion, m.confusion_matrix(p)) and same(flags, m.message_flags(p))
    assert same(m.counted_accuracy(confusion), m.field_accuracy(p)) and same(m.counted_classes(confusion), m.class_recall_precision(p))
