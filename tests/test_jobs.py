import json

import pytest
from pyspark.sql import functions as F

from tallymark.functions.labels import FIELDS
from tallymark.functions.storage import numbered
from tallymark.jobs.prepare import prepare
from tallymark.jobs.report import evaluation_report
from tallymark.operators import metrics as m
from tallymark.operators import pseudonyms as p
from tallymark.operators import votes as v
from tallymark.sources import files as f


def test_prepare(spark, tmp_path):
    for i, (to, body) in enumerate([("Ich Selbst <ich@me.de>", "Hallo Herr Selbst, Maria Schulz kommt.\r\n\r\n\r\n\r\nGruss\r\n> alt"), ("ich@me.de", "")]):
        (tmp_path / f"{i}_x.eml").write_bytes(f"From: Maria Schulz <m.schulz@firma.de>\r\nTo: {to}\r\nSubject: A  B\r\n\r\n{body}".encode())
    (tmp_path / "note.txt").write_text("no mail")
    prepare(spark, str(tmp_path), str(tmp_path / "out"))
    got = {r.id: r for r in spark.read.json(str(tmp_path / "out/records")).collect()}
    assert got["0"].sender == "[PERSON_1] <[EMAIL_1]@firma.de>" and got["0"].subject == "A B" and got["0"].text == "Hallo [ICH], [PERSON_1] kommt.\n\nGruss"
    s = spark.read.json(str(tmp_path / "out/summary")).first()
    assert (s.files, s.unreadable, s.written, s.without_text, s.known_tokens) == (2, 0, 2, 1, 4) and s.replaced.PERSON == 2


def test_budget_goes_by_ranges(spark):
    rows = [(i, None if i % 5 == 0 else "hot" if i % 3 else "b", 1.0 + i % 7) for i in range(600)]
    got = {r.seq for r in v.budget_cutoff(spark.createDataFrame(rows, "seq int, model string, cost_usd double"), 100, ["model"], 3.0).collect()}
    spent, want = {}, set()
    for i, model, cost in rows:
        if spent.setdefault(model, 3.0) < 100:
            want.add(i)
        spent[model] += cost
    assert got == want
    ten = spark.createDataFrame([(i, 1.0) for i in range(10)], "seq int, cost_usd double")
    assert v.budget_cutoff(ten, 4, []).count() == 4
    assert v.budget_cutoff(ten.limit(0), 4, []).count() == 0


def test_numbers_within_groups(spark):
    rows = [(g, i) for g in ("a", "b", None) for i in range(50)]
    got = numbered(spark.createDataFrame(rows, "g string, i int"), [F.col("i")], "n", within=("g",)).collect()
    assert len(got) == 150 and all(r.n == r.i + 1 for r in got)


def test_review_sample(spark):
    before = spark.createDataFrame([(i, "s", f"<{i}> Anna") for i in range(30)], "id int, subject string, text string")
    after = before.withColumn("text", F.replace("text", F.lit("Anna"), F.lit("[PERSON_1]"))).where("id < 25")
    a, b = (sorted(p.review_sample(before, after, 6, 1).collect()) for _ in range(2))
    assert a == b and len(a) == 6
    assert all(r.text_before == f"&lt;{r.id}&gt; Anna" and r.text_after == f"&lt;{r.id}&gt; <mark>[PERSON_1]</mark>" for r in a)


def test_large_samples_go_through_no_single_task(spark, monkeypatch):
    rows = [(i if i % 7 else None if i % 2 else 7, i, {"a": i % 5}, f"t{i % 50}" if i % 9 else "") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, row int, extra map<string,int>, text string").repartition(5)
    draw = lambda n, df=df: v.draw_sample(df, n, 3, ("text",))
    hashes = {r.row: r.h for r in df.where("text <> ''").select("row", F.xxhash64(F.col("id").cast("string"), F.lit(3)).alias("h")).collect()}
    total = len(hashes)
    for n in (101, 700, 2000, total - 1, total, total + 1):
        got = draw(n)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrdered" not in plan and "Limit" not in plan
        got = [r.row for r in got.collect()]
        assert len(got) == len(set(got)) == min(n, total) and sorted(hashes[r] for r in got) == sorted(hashes.values())[:n]
        assert sorted(r.row for r in draw(n, df.repartition(3, "row")).collect()) == sorted(got)
    unique = df.where("id % 7 <> 0")
    few = draw(60, unique).collect()
    monkeypatch.setattr(v, "HELD", 0)
    assert draw(60, unique).collect() == few and draw(0).collect() == [] and draw(5, df.limit(0)).collect() == []
    hot = spark.createDataFrame([(7, "same")] * 400, "id long, text string")
    assert v.draw_sample(hot, 150, 1, ("text",)).count() == 150


def test_large_reviews_go_through_no_single_task(spark):
    before = spark.createDataFrame([(i, f"<{i}> Anna") for i in range(500)], "id int, text string").repartition(5)
    after = before.withColumn("text", F.replace("text", F.lit("Anna"), F.lit("[PERSON_1]")))
    for n in (300, 500):
        got = p.review_sample(before, after, n, 1, ("text",))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrdered" not in plan and "Limit" not in plan and "SinglePartition" not in plan
        got = got.collect()
        assert len({r.id for r in got}) == len(got) == n and all((r.text_before, r.text_after) == (f"&lt;{r.id}&gt; Anna", f"&lt;{r.id}&gt; <mark>[PERSON_1]</mark>") for r in got)


def test_recognizers_by_language(spark):
    texts = spark.createDataFrame([(1, "body", "the cat and the dog is here with you"), (2, "body", "und der Hund ist nicht da"), (3, "body", None)], "id long, field string, text string")
    got = p.name_spans(texts, {"en": lambda xs: [[(4, 7)] for _ in xs]})
    assert {r.id: len(r.found) for r in got.collect()} == {1: 1, 2: 0, 3: 0}


def test_answers_off_the_schema(spark):
    good = {x.name: (x.classes[0].strip('"') if x.kind == "string" else True) for x in FIELDS}
    answers = {"1": json.dumps(good), "2": json.dumps(good | {"mood": "x"}), "3": "oops"}

    def classify(i, text):
        if i == "4":
            raise TimeoutError("slow")
        return {"model": "m", "answer": answers[i], "tokens_in": 1000, "tokens_out": 100}

    prices = spark.createDataFrame([("m", 2.0, 10.0)], "model string, usd_in double, usd_out double")
    got = {r.id: r for r in f.score_with(spark.createDataFrame([(i, "t") for i in range(1, 5)], "id long, text string"), classify, FIELDS, prices).collect()}
    assert got["1"].answer == answers["1"] and got["1"].error is None and got["1"].cost_usd == pytest.approx(0.003)
    assert got["2"].answer is None and got["2"].error == "Schema: fields" and got["3"].answer is None and got["3"].error.startswith("Schema: ") and got["4"].error == "TimeoutError: slow"


def test_report_sections(spark, tmp_path):
    evaluation_report(spark, "/root/testdata/sf0.001", str(tmp_path / "r"))
    for name in ("hybrid", "hybrid_best", "generator_bias", "intent_agreement", "errors"):
        rows = spark.read.json(str(tmp_path / f"r/{name}"))
        lines = [r[0] for r in spark.read.text(str(tmp_path / f"r/markdown/{name}")).collect()]
        assert rows.count() > 0 and lines[0] == f"## {name}" and lines[2].startswith("| ") and len(lines) == rows.count() + 4
    assert {r.fallback for r in spark.read.json(str(tmp_path / "r/hybrid")).collect()} == {"fallback"}
    assert {r.dataset for r in spark.read.json(str(tmp_path / "r/generator_bias")).collect()} == {"synthetic"}


def test_approximate_latencies(spark):
    log = spark.range(1000).select(F.lit("d").alias("dataset"), F.lit("m").alias("model"), F.lit("x").alias("answer"), F.col("id").cast("double").alias("latency_ms"))
    exact, near = m.latency_stats(log).first(), m.latency_stats(log, 10_000).first()
    assert exact.p50 == 499.5 and abs(near.p50 - exact.p50) <= 1 and abs(near.p95 - exact.p95) <= 1
