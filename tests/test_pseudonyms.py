import pytest
from pyspark.sql import functions as F

from tallymark.functions import spans as s
from tallymark.operators import pseudonyms as p


def tagged(text, tokens=()):
    out, at = "", 0
    for a, b, k in s.find(text, set(tokens)):
        out, at = out + text[at:a] + s.TAGS.get(k, f"<{k}>"), b
    return out + text[at:]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Tel. +49 30 1234567.", "Tel. [TELEFON]."), ("am 24.12.2025 um 10:30", "am 24.12.2025 um 10:30"), ("DE89 3704 0044 0532 0130 00", "[IBAN]"), ("4111 1111 1111 1111", "[KARTE]"),
        ("Hauptstraße 12a in 10115 Berlin", "[ADRESSE] in [PLZ_ORT]"), ("10000 Euro", "10000 Euro"), ("siehe https://www.x.de/a?b=1.", "siehe <URL>."), ("a.b@firma.de!", "<EMAIL>!"), ("Nr. 1234567", "Nr. [NUMMER]"),
        ("Hallo Maria Schulz,", "Hallo <PERSON>,"), ("Hallo zusammen", "Hallo zusammen"), ("Viele Grüße\nMax", "Viele Grüße\n<PERSON>"),
    ],
)
def test_spans(text, want):
    assert tagged(text) == want


def test_known_names():
    assert tagged("Maria's Auto, Maria-Luise, maria, MARIA Schulz", ["maria", "schulz"]) == "<PERSON>'s Auto, Maria-Luise, maria, <PERSON>"


def test_person_ids(spark):
    rows = [(1, ["maria", "schulz"]), (2, ["maria", "müller"]), (3, ["maria"]), (4, ["maria", "schulz"]), (5, []), (6, ["own", "er"]), (7, ["zoe"])]
    got = p.person_ids(spark.createDataFrame(rows, "at int, tokens array<string>"), ["own", "er"])
    assert dict(map(tuple, got.collect())) == {"maria schulz": 1, "maria müller": 2, "maria": 1, "zoe": 3}


def box(name, addr):
    return (name, addr)


def test_corpus(spark):
    me = box("Ich Selbst", "ich@me.de")
    rows = [
        ("1", 1, box("Schulz, Maria", "m.schulz@firma.de"), [me], [], "Hallo", "Hallo Herr Selbst, ruf Maria an: 030 1234567. maria@schulz-bau.de, info@firma.de, https://www.schulz-bau.de/x"),
        ("2", 2, box("", "rechnung@firma.de"), [me, box("Max Muster", "max@gmx.de")], [], "Rechnung", "Viele Grüße\nMaria Schulz"),
        ("3", 3, None, [box("Max Muster", "max@gmx.de")], [me], "", None),
    ]
    mails = spark.createDataFrame(rows, f"id string, position int, sender {p.MAILBOX}, to array<{p.MAILBOX}>, cc array<{p.MAILBOX}>, subject string, body string")
    assert p.infer_identity(mails) == ("ich@me.de", "Ich Selbst")
    records, stats = p.anonymize_corpus(mails)
    got = {r.id: r for r in records.collect()}
    assert got["1"].sender == "[PERSON_1] <[EMAIL_1]@firma.de>"
    assert got["1"].text == "Hallo [ICH], ruf [PERSON_1] an: [TELEFON]. [EMAIL_2]@[DOMAIN], info@firma.de, [URL:[DOMAIN]]"
    assert got["2"].sender == "rechnung@firma.de" and got["2"].text == "Viele Grüße\n[PERSON_1]" and got["2"].direct and got["2"].recipients == 2
    assert got["3"].sender is None and not got["3"].direct and got["3"].text is None
    counts = dict(map(tuple, stats.collect()))
    assert counts["EMAIL"] == 2 and counts["URL"] == 1 and counts["PHONE"] == 1
    left = dict(map(tuple, p.residual_audit(records).collect()))
    assert left == {"EMAIL": 0, "IBAN": 0, "PHONE": 0, "CARD": 0}
    summary = p.prepare_summary(records, stats, p.residual_audit(records)).first()
    assert summary.written == 3 and summary.without_text == 1 and summary.residual["CARD"] == 0


def test_marks(spark):
    got = spark.createDataFrame([("<a> [PERSON_3] & [URL:x.de]",)], "x string").select(p.mark_placeholders(F.col("x"))).first()[0]
    assert got == "&lt;a&gt; <mark>[PERSON_3]</mark> &amp; <mark>[URL:x.de]</mark>"


def test_recognizer_hook(spark):
    texts = spark.createDataFrame([(1, "body", "Anna kam"), (2, "body", None)], "id long, field string, text string")
    got = p.name_spans(texts, lambda xs: [[(0, 4)] if x else [] for x in xs], 1)
    assert {r.id: [tuple(x) for x in r.found] for r in got.collect()} == {1: [(0, 4)], 2: []}
    marked = p.find_spans(texts, spark.createDataFrame([], "token string"), got)
    assert {r.id: len(r.spans) for r in marked.collect()} == {1: 1, 2: 0}


def test_implausible_names_are_dropped(spark):
    text = "Anna kam, Hallo Anna, Muster GmbH, anna"
    places = [(0, 4), (10, 20), (22, 33), (35, 39)]
    found = spark.createDataFrame([(1, "body", [{"start": a, "end": b} for a, b in places])], "id long, field string, found array<struct<start:int,end:int>>")
    got = p.find_spans(spark.createDataFrame([(1, "body", text)], "id long, field string, text string"), spark.createDataFrame([], "token string"), found).first().spans
    assert [(x.start, x.end) for x in got if x.start == 0] == [(0, 4)] and not any(x.start >= 22 for x in got)


@pytest.mark.parametrize(("spans", "want"), [([(0, 5, "PERSON"), (3, 9, "EMAIL")], [(3, 9)]), ([(0, 5, "NUMBER"), (0, 7, "NUMBER")], [(0, 7)]), ([(0, 2, "PHONE"), (1, 3, "PHONE"), (2, 4, "PHONE")], [(0, 2), (2, 4)]), ([(4, 4, "URL")], [])])
def test_overlaps(spans, want):
    assert [(x.start, x.end) for x in s.resolved([s.Span(*x) for x in spans])] == want


@pytest.mark.parametrize(
    ("text", "tokens", "want"),
    [
        ("Das ist O'Neil's Haus", ["o'neil"], "Das ist <PERSON>'s Haus"), ("O’Neil’s", ["o’neil"], "<PERSON>’s"), ("o'Neil kam", ["o'neil", "neil"], "o'Neil kam"), ("D'Arc'Ys'La'Mar's Pferd", ["d'arc'ys'la'mar"], "<PERSON>'s Pferd"),
        ("x'Maria's", ["maria"], "x'<PERSON>'s"), ("Maria's-Luise", ["maria"], "<PERSON>'s-Luise"), ("O'Neil-Weber", ["o'neil"], "O'Neil-Weber"), ("'Maria' und Maria", ["maria"], "'<PERSON>' und <PERSON>"),
    ],
)
def test_names_around_apostrophes(text, tokens, want):
    assert tagged(text, tokens) == want


def test_match_join_gives_the_same_spans(spark):
    texts = ["Das ist O'Neil's Haus, sagt Maria-Luise zu maria und MARIA", "o'Neil, O'neil'S Maria's", "", None, "A'" * 3000 + "Maria's", "Maria " * 2000, "Maria Maria"]
    df = spark.createDataFrame([(i, 3, t) for i, t in enumerate(texts)], "id long, field int, text string")
    tokens = spark.createDataFrame([("maria",), ("o'neil",), ("neil",), ("maria",), ("xx",), (None,)], "token string")
    both = [{r.id: [tuple(x) for x in r.spans or []] for r in p.find_spans(df, tokens, held_bytes=size).collect()} for size in (p.MAX_HELD_TOKENS, 0)]
    assert both[0] == both[1] and [len(both[0][i]) for i in range(7)] == [2, 2, 0, 0, 1, 1, 1]
    places = p.known_names(df, tokens).where("id = 5").collect()
    assert len(places) == 2000 and {r.end - r.start for r in places} == {5}


def test_no_name_stays_in_a_mail(spark):
    rows = [("1", 1, box("Sean O'Neil", "sean@firma.de"), [box("Me", "me@x.de")], [], "Hi", "das ist in O'Neil's Haus")]
    mails = spark.createDataFrame(rows, f"id string, position int, sender {p.MAILBOX}, to array<{p.MAILBOX}>, cc array<{p.MAILBOX}>, subject string, body string")
    assert p.anonymize_corpus(mails)[0].first().text == "das ist in [PERSON_1]'s Haus"


def test_person_ids_take_time_in_proportion(spark, tmp_path):
    import time

    import __spark_entry__ as entry

    def seconds(words):
        path = str(tmp_path / str(words))
        spark.createDataFrame([(1, "abc def " * (words // 2))], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
        start = time.perf_counter()
        got = entry.queries()["person_ids"](spark, path)
        assert got.count() == 2
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(1_000_000) < 20 * seconds(100_000) + 5


def test_recognizers_are_held_by_language(spark, tmp_path):
    import os

    log = str(tmp_path)

    def opener(lang):
        def open_():
            import uuid

            with open(f"{log}/{lang}_{os.getpid()}_{uuid.uuid4().hex}", "w"):
                pass
            return lambda part: [[(0, len(lang))] for _ in part]

        return open_

    texts = spark.createDataFrame([(i, 1, "the and is you we with" if i % 3 else "der die das und ist nicht") for i in range(300)], "id long, field int, text string")
    got = {r.id: [tuple(x) for x in r.found] for r in p.name_spans_held(texts, {"en": opener("en")}, 7).collect()}
    assert got == {i: [(0, 2)] if i % 3 else [] for i in range(300)}
    assert {x.split("_")[0] for x in os.listdir(log)} == {"en"} and len(os.listdir(log)) == len({x.split("_")[1] for x in os.listdir(log)})  # once a worker
    with pytest.raises(Exception, match="1 results for 7 texts"):
        p.name_spans_held(texts, lambda: lambda part: [[]], 7).collect()
