import time

import pytest
from pyspark.sql import functions as F

from tallymark.functions import names as n
from tallymark.functions import text as t


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Hallo\r\n\r\n\r\n\r\nWelt   x​", "Hallo\n\nWelt x"),
        ("neu\n> alt\nnoch", "neu\nnoch"),
        ("Text\n-- \nSignatur", "Text"),
        ("Antwort\nAm 1.1.2026 um 10:00 schrieb Max Muster:\n> alt", "Antwort"),
        ("Antwort\nOn Mon, Jan 1, 2026 at 10:00 Max\nMuster wrote:\nalt", "Antwort"),
        ("Text\nVon: A B\nGesendet: heute\nAn: C\nalt", "Text"),
        ("Siehe unten\n---------- Forwarded message ---------\nVon: A B\nDatum: heute\nAn: C\n\nInhalt", "Siehe unten\n---------- Forwarded message ---------\nVon: A B\nDatum: heute\nAn: C\n\nInhalt"),
        ("Text\n-----Original Message-----\nalt", "Text"),
        ("", ""),
    ],
)
def test_clean_body(spark, raw, want):
    assert one(spark, t.clean_body, raw) == want


def test_truncate(spark):
    assert one(spark, lambda c: t.truncate_text(c, 10), "kurz") == "kurz"
    assert one(spark, lambda c: t.truncate_text(c, 10), "eins zwei drei") == "eins zwei …"
    assert one(spark, lambda c: t.truncate_text(c, 10), "ab " + "x" * 30) == "ab xxxxxxx …"


def test_html():
    html = "<html><head><title>T</title></head><body><p>Hi <b>you</b></p><script>var t='</p>';</script><blockquote>old<p>er</p></blockquote><div class='x gmail_quote'>q</div>&amp; end</body></html>"
    assert t.text_of_html(html) == "Hi \nyou\n& end"


def test_language(spark):
    assert one(spark, t.detect_language, "please send the report") == "en"
    assert one(spark, t.detect_language, "bitte den Bericht") == "de"
    assert one(spark, t.detect_language, "") == "de"


def test_names(spark):
    assert one(spark, n.normalize_name, "Schulz, Maria") == "Maria Schulz"
    assert one(spark, n.normalize_name, ' "Schulz" ') == "Schulz"
    assert one(spark, n.normalize_name, "a, b, c") == "a, b, c"
    assert one(spark, n.name_tokens, "Prof. Dr. Anna-Lena von der Tann") == ["anna-lena", "tann"]


@pytest.mark.parametrize(
    ("name", "addr", "want"),
    [("Maria Schulz", "m.schulz@firma.de", True), ("Maria", "maria@firma.de", True), ("Maria", "x@firma.de", False), ("Firma GmbH", "info@firma.de", False), ("Team Support", "help@x.de", False), ("Max 24", "max@gmail.com", False), ("max", "max@gmail.com", False), ("Max", "info@gmail.com", True), ("Max Muster", "noreply@x.de", False), ("", "a@b.de", False), ("Anna von Berg", "ab@x.de", True), ("A B C D E", "a@b.de", False)],
)
def test_looks_like_person(spark, name, addr, want):
    assert spark.createDataFrame([(name, addr)], "a string, b string").select(n.looks_like_person(F.col("a"), F.col("b"))).first()[0] is want


def test_lines_as_rows_give_the_same_start(spark):
    import random

    rng = random.Random(4)
    lines = ["", "text", "-- ", "--", "> q", "On Mon, 1 Jan 2026 a wrote:", "Am Montag, dem ersten, schrieb", "A B:", "wrote:", "From: a", "Von: b", "Sent: c", "An: d", "Forwarded message", "----- Weitergeleitete Nachricht -----", "--- Original Message ---", "x:"]
    bodies = ["\n".join(rng.choices(lines, weights=[9, 30] + [1] * 15, k=rng.randrange(1, 40))) for _ in range(400)] + ["", None, "a\n" * 20_000 + "-- \nb", "Forwarded message\n" + "From: a\nTo: b\n" * 4 + "From: a\nTo: b"]
    df = spark.createDataFrame(list(enumerate(bodies)), "id long, text string")
    want = {r.id: r.start for r in df.where("text is not null").select("id", t.history_start(F.split("text", "\n")).alias("start")).collect()}
    assert {r.id: r.start for r in t.history_starts(df).collect()} == want and len(set(want.values())) > 10


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("\n".join(["a  b", "> q"] * 4000 + ["Forwarded message", "From: x", "To: y", "", "On Monday someone", "wrote:", "c", "d", "e", "-- ", "z"]), "\n".join(["a b"] * 4000 + ["Forwarded message", "From: x", "To: y", "", "On Monday someone", "wrote:", "c", "d", "e"])),
        ("Forwarded message\n" * 4000 + "From: a\nTo: b\n" * 8, "\n".join(["Forwarded message"] * 4000 + ["From: a", "To: b"] * 4)),
        ("a" + "\u2003" * 200_000 + "b", "a" + "\u2003" * 200_000 + "b"),
        ("Forwarded message" + "\u2003" * 5000 + "x", "Forwarded message" + "\u2003" * 5000 + "x"),
        ("\u200b\r\r\n\u00ada\u2060\ufeff\u034f\u200c\u200db \u2003\x85\n\u3000\n\n\n\x0bc\r\n\r", "ab\n\nc"),
    ],
)
def test_long_bodies_take_time_in_proportion(spark, raw, want):
    start = time.perf_counter()
    assert one(spark, t.clean_body, raw) == want
    assert time.perf_counter() - start < 20
