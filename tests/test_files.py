import json

import pytest
from pyspark.sql import functions as F

from tallymark.jobs.report import evaluation_report
from tallymark.operators import mailbox, synth
from tallymark.operators import votes as v
from tallymark.sources import files as f


def test_jsonl_keeps_odd_line_ends(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"1","t":"a b"}\n\n{"id":"2","t":null}\n', encoding="utf-8")
    df = f.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id string, t string")
    assert sorted(map(tuple, df.collect())) == [("1", "a b"), ("2", None)]
    f.write_jsonl(df, str(tmp_path / "b"))
    assert f.read_jsonl(spark, str(tmp_path / "b"), "id string, t string").count() == 2


def test_eml(spark, tmp_path):
    (tmp_path / "0001_2026-09-30.eml").write_bytes(b"From: =?utf-8?q?M=C3=BCller?= <A@x.de>\r\nTo: b@y.de, C <c@z.de>\r\nSubject: Hi\r\nDate: Wed, 30 Sep 2026 10:00:00 +0200\r\nList-Id: <l>\r\nContent-Type: text/html\r\n\r\n<p>Hallo</p>")
    (tmp_path / "0002_x.eml").write_bytes(b"Subject: only\r\nDate: nonsense\r\n\r\ntext")
    got = {r.id: r for r in f.read_eml(spark, str(tmp_path)).collect()}
    assert got["0001"].sender.asDict() == {"name": "Müller", "addr": "a@x.de"} and [t.addr for t in got["0001"].to] == ["b@y.de", "c@z.de"]
    assert got["0001"].date == "2026-09-30T10:00:00+02:00" and got["0001"].is_list and got["0001"].body.strip() == "Hallo"
    assert got["0002"].date is None and got["0002"].sender is None and got["0002"].body == "text" and got["0002"].error is None


def test_decisions_and_ids(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"7": {"urgency": "now", "phishing": True}}))
    assert sorted(map(tuple, f.read_decisions(spark, str(tmp_path / "d.json")).collect())) == [("7", "phishing", "true"), ("7", "urgency", "now")]
    f.write_sample_ids(spark.createDataFrame([(1,), (2,)], "id int"), str(tmp_path / "ids"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "ids")).collect()) == ["1", "2"]


def test_append_counts_a_repeated_batch_once(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "id int, dataset string, model string"
    log = lambda n: spark.createDataFrame([(i, "real", "ab"[i % 2]) for i in range(n)], schema)
    assert f.read_results(spark, path, schema).count() == 0
    assert f.append_results(log(3), path, "first") and not f.append_results(log(3), path, "first")
    log(5).write.partitionBy("dataset", "model").parquet(f"{path}/data/batch=second")  # what a stopped run has left
    assert f.read_results(spark, path, schema).count() == 3
    assert f.append_results(log(2), path, "second")
    got = f.read_results(spark, path, schema)
    assert sorted((r.batch, r.id, r.model) for r in got.collect()) == [("first", 0, "a"), ("first", 1, "b"), ("first", 2, "a"), ("second", 0, "a"), ("second", 1, "b")]
    with pytest.raises(ValueError, match="named"):
        f.append_results(log(1), path, "a/b")
    # what is still to be done is told from complete batches only
    done = got.where("batch = 'first'").withColumn("run", F.lit(1)).withColumn("answer", F.lit("{}"))
    todo = v.pending_work(spark.createDataFrame([("a",)], "model string"), log(4).select("id"), done, spark.createDataFrame([(1,)], "run int"))
    assert sorted(r.id for r in todo.collect()) == [1, 3]


def eml(subject, body):
    return f"From: a@x.de\r\nTo: b@y.de\r\nSubject: {subject}\r\n\r\n{body}".encode()


def test_store_parses_what_is_new(spark, tmp_path):
    folder, store = tmp_path / "mail", str(tmp_path / "store")
    folder.mkdir()
    for i in range(5):
        (folder / f"{i:04}_x.eml").write_bytes(eml(f"s{i}", f"text {i}"))
    (folder / "note.txt").write_bytes(b"no mail")
    (folder / "0009_copy.eml").write_bytes(eml("s1", "text 1"))
    assert f.pack_mails(spark, str(folder), store, files_per_batch=2) == 5
    assert f.pack_mails(spark, str(folder), store) == 0
    rows = lambda: {r.id: (r.subject, r.body) for r in f.read_mails(spark, store).collect()}
    assert rows() == {**{f"{i:04}": (f"s{i}", f"text {i}") for i in range(5)}, "0009": ("s1", "text 1")}
    assert f.read_mails(spark, store).schema == f.read_eml(spark, str(folder)).schema
    (folder / "0005_y.eml").write_bytes(eml("s5", "text 5"))
    (folder / "0006_copy.eml").write_bytes(eml("s2", "text 2"))  # a new name for a known content
    assert f.pack_mails(spark, str(folder), store) == 1 and f.pack_mails(spark, str(folder), store) == 0
    assert len(rows()) == 8 and rows()["0006"] == ("s2", "text 2") and rows()["0005"] == ("s5", "text 5")
    want = sorted(map(str, f.read_eml(spark, str(folder)).collect()))
    assert sorted(map(str, f.read_mails(spark, store).collect())) == want


def counting(log):
    """A classifier's opener; each opening and call leaves a file."""

    def note(what):
        import os
        import uuid

        with open(f"{log}/{what}_{os.getpid()}_{uuid.uuid4().hex}", "w"):
            pass

    def classify(part):
        note("call")
        if any(t == "all bad" for _, t in part):
            raise TimeoutError("too slow")
        out = {i: {"model": "m", "answer": t, "cost_usd": 0.5} for i, t in reversed(part) if t != "left out"}
        return out | {i: ValueError("no schema") for i, t in part if t == "bad"}

    def open_():
        note("open")
        return classify

    return open_


def test_batches_are_aligned_and_failures_told_apart(spark, tmp_path):
    log = str(tmp_path)
    texts = [(i, "bad" if i == 3 else "left out" if i == 5 else "all bad" if i == 70 else f"t{i}") for i in range(100)]
    df = spark.createDataFrame(texts, "id long, text string").coalesce(1)
    got = {int(r.id): r for r in f.score_in_batches(df, counting(log), batch=10).collect()}
    import os

    kinds = [x.split("_")[0] for x in os.listdir(log)]
    assert kinds.count("open") == 1 and kinds.count("call") == 10 + 10  # ten lists, and the texts of the one that failed
    assert got[3].error == "ValueError: no schema" and got[5].error.startswith("missing") and got[70].error == "TimeoutError: too slow"
    assert all(got[i].answer == f"t{i}" and got[i].error is None for i in range(100) if i not in (3, 5, 70))


def test_an_unknown_error_ends_the_job(spark):
    def classify(part):
        raise KeyError("bug")

    with pytest.raises(Exception, match="bug"):
        f.score_in_batches(spark.createDataFrame([(1, "a")], "id long, text string"), lambda: classify).collect()


def test_score_with(spark):
    def classify(i, text):
        if text == "bad":
            raise ValueError("no schema")
        return {"model": "m", "answer": "{}", "cost_usd": 0.5}

    got = {r.id: r for r in f.score_with(spark.createDataFrame([(1, "a"), (2, "bad")], "id long, text string"), classify).collect()}
    assert got["1"].answer == "{}" and got["2"].answer is None and got["2"].error == "ValueError: no schema"


def test_report(spark, tmp_path):
    evaluation_report(spark, "/root/testdata/sf0.001", str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/scorecard")).count() == 4
    assert all(r[0].startswith("| ") for r in spark.read.text(str(tmp_path / "r/summary")).collect())


def test_mailbox_order(spark):
    rows = [("k1", "a", "2026-01-01", "x"), ("k2", "a", "2026-02-01", "x"), ("k3", "", "2026-01-15", "x"), ("k4", "", "2026-01-10", "x"), ("k5", "b", None, "x"), ("k6", "c", "2026-03-01", "x"), ("k7", None, None, "x")]
    df = spark.createDataFrame(rows, "key string, message_id string, received string, source string").withColumn("received", F.to_timestamp("received"))
    kept = mailbox.dedupe_latest(mailbox.drop_blocked(df, spark.createDataFrame([("c",), ("",)], "message_id string")), "key")
    got = mailbox.export_names(mailbox.latest_n(kept, 6, "key", "source"), "key").orderBy("file_name").collect()
    assert [r.key for r in got] == ["k2", "k3", "k4", "k5", "k7"] and got[0].file_name == "0001_2026-02-01.eml" and got[3].file_name == "0004_unbekannt.eml"
    paths = spark.createDataFrame([(["Inbox", "Ärger "],), (["Archive"],), (None,)], "mailbox_path array<string>")
    assert [r.excluded for r in mailbox.exclude_folders(paths, ["ärger"]).collect()] == [True, False, False]


def test_samples_and_decisions(spark):
    df = spark.createDataFrame([(str(i), "t" if i % 2 else "", None) for i in range(40)], "id string, text string, subject string")
    a, b = (v.draw_sample(df, 7, 42).collect() for _ in range(2))
    assert a == b and len(a) == 7 and [r.id for r in a] == sorted(r.id for r in a) and all(r.text for r in a)
    assert v.draw_sample(df, 99, 1).count() == 20
    truth = spark.createDataFrame([("1", (None, "other", True, False))], "id string, truth struct<urgency:string,category:string,reply_needed:boolean,phishing:boolean>").withColumns({"votes": F.lit(3), "agreement": F.create_map(F.lit("urgency"), F.lit(1)), "open": F.array(F.lit("urgency"))})
    ok = v.apply_decisions(truth, spark.createDataFrame([("1", "urgency", "now")], "id string, field string, value string")).first()
    assert ok.truth.urgency == "now" and ok.open == [] and ok.manual == ["urgency"]
    for bad in (("2", "urgency", "now"), ("1", "mood", "x")):
        with pytest.raises(ValueError, match="unknown"):
            v.apply_decisions(truth, spark.createDataFrame([bad], "id string, field string, value string"))


def test_synthetic_corpus(spark):
    sc = spark.createDataFrame([(1, "a", 3, "A", "now", "other", True, False), (2, "b", 1, "B", "later", "other", False, True)], "position int, key string, weight int, description string, urgency string, category string, reply_needed boolean, phishing boolean")
    drawn = synth.round_robin_generator(synth.draw_scenarios(spark, 800, sc, 5), ["x", "y", "z"], ["x", "z"])
    got = synth.draw_attributes(drawn, 5, ("i1", "i2"), ("short", "long"), ("t1",), long_for="b", copies=("a",)).withColumn("prompt", synth.render_prompt())
    rows = got.collect()
    assert len(rows) == 800 and 530 < sum(r.key == "a" for r in rows) < 670 and {r.length for r in rows if r.key == "b"} == {"long"} and all(3 <= r.recipients <= 40 for r in rows if r.key == "a")
    turns = [r.generator for r in sorted(rows, key=lambda r: r.row) if r.key == "b"]
    assert turns[:4] == ["x", "z", "x", "z"]
    assert sorted(rows) == sorted(synth.draw_attributes(drawn, 5, ("i1", "i2"), ("short", "long"), ("t1",), long_for="b", copies=("a",)).withColumn("prompt", synth.render_prompt()).collect())
    raw = json.dumps({"sender": "s", "subject": "b", "text": "t", "attachments": 1})
    mails = spark.createDataFrame([("S001", raw, 0.1), ("S002", raw.replace("1}", "true}"), 0.1), ("S003", raw.replace('"t"', '" "'), 0.1), ("S004", "oops", 0.1)], "id string, raw string, cost_usd double")
    record = synth.assemble_record(got, mails).collect()
    assert [r.id for r in record] == ["S001"] and record[0].intent.urgency in ("now", "later") and record[0].frame["tone"] == "t1"
    pending, progress = synth.generation_progress(got, spark.createDataFrame([("S001", True, 0.5), ("S002", False, None)], "id string, ok boolean, cost_usd double"))
    assert pending.count() == 798 and tuple(progress.first()) == (1, 1, 2, 0.5)


def test_alias_table_has_the_weights():
    for weights in ([3, 1], [1], [5, 5, 5], [0, 7, 0, 1], list(range(1, 40)), [10**6, 1, 1]):
        table, room, n = synth.alias_table(weights), sum(weights), len(weights)
        share = [0] * n
        for slot, own, other in table:
            share[slot] += own
            share[other] += room - own
        assert [slot for slot, *_ in table] == list(range(n)) and all(0 <= own <= room for _, own, _ in table) and share == [w * n for w in weights]


def test_draws_follow_the_weights_without_a_nested_loop(spark):
    sc = spark.createDataFrame([(i, f"k{i}", w) for i, w in enumerate([1, 50, 0, 9, 40])], "position int, key string, weight int")
    drawn = synth.draw_scenarios(spark, 20_000, sc, 11)
    counts = {r.key: r["count"] for r in drawn.groupBy("key").count().collect()}
    assert "k2" not in counts and all(abs(counts[f"k{i}"] / 20_000 - w / 100) < 0.015 for i, w in enumerate([1, 50, 0, 9, 40]) if w)
    assert "NestedLoop" not in drawn._jdf.queryExecution().toString()
    for bad in (sc.where("weight = 0"), sc.where("false")):
        with pytest.raises(ValueError, match="weight"):
            synth.draw_scenarios(spark, 5, bad, 1)
    with pytest.raises(ValueError, match="between"):
        synth.draw_scenarios(spark, 5, sc, 1, most=4)
