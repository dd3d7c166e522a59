"""Cleaning and describing message texts, as column expressions wherever Spark has the functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from html.parser import HTMLParser
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters, words and patterns that results depend on. Runs that can't be cut otherwise are possessive, or a line of spaces would take powers of its length.
INVISIBLE = "[\u200b\u200c\u200d\u2060\ufeff\u00ad\u034f]"
SPACES = "[ \t\u00a0\u2007\u202f]+"
GERMAN = ("der", "die", "das", "und", "ist", "nicht", "ich", "sie", "wir", "mit", "für", "auf", "ein", "eine", "zu", "von", "den", "dem", "bitte", "ihr", "ihre", "sind", "wird", "auch", "noch", "bei", "aus", "hallo", "grüße")
ENGLISH = ("the", "and", "is", "not", "you", "we", "with", "for", "on", "a", "to", "of", "your", "please", "this", "that", "are", "will", "be", "from", "have", "our", "hi", "thanks", "regards")
ATTRIBUTION = r"(?iU)^\s*(Am|On)\b.{5,250}\b(schrieb|wrote)\b.*:\s*$"
ORIGINAL = r"(?iU)^\s*+-{2,}+\s*+(Original Message|Ursprüngliche Nachricht|Originalnachricht)\s*+-{2,}+\s*+$"
FORWARDED = r"(?iU)^\s*+-*+\s*+(Forwarded message|Weitergeleitete Nachricht|Begin forwarded message|Anfang der weitergeleiteten Nachricht)\s*+:?\s*+-*+\s*+$"
FROM_LINE = r"^\s*\*?(Von|From)\s*:\*?\s+\S"
AFTER_FROM = r"^\s*\*?(Gesendet|Sent|Datum|Date|An|To)\s*:\*?\s"
SIGNATURE = "^-- ?$"
#: Lines after a forward marker that belong to the forwarded header; lines in which a From line is followed up.
FORWARD_HEADER, FOLLOW_UP = 8, 4


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once a row: an expression that a lambda mentions is computed anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends, of whatever kind. A run inside is tried from its first character only."""
    return F.regexp_replace(text, r"(?U)^\s++|(?<!\s)\s++$", "")


def clean_inline(text: Column) -> Column:
    """Without invisible characters; each run of horizontal space becomes one space."""
    return strip(F.regexp_replace(F.regexp_replace(text, INVISIBLE, ""), SPACES, " "))


def drop_quoted_lines(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~x.rlike(r"^\s*>"))


def history_start(lines: Column) -> Column:
    """Index of the first line of a signature or quoted history; the number of lines if there is none.

    A forward marker and the lines of the header after it are exempt. Attributions may be wrapped over two lines.
    """
    return bound(lines, _history_start)


def _history_start(lines: Column) -> Column:
    """history_start() of lines that are at hand: each looks at a few others by index, so work grows with their number."""

    def near(i: Column, places: range, pattern: str) -> Column:
        return F.coalesce(reduce(or_, (F.get(lines, i + k).rlike(pattern) for k in places)), F.lit(False))

    def begins(x: Column, i: Column) -> Column:
        wrapped = ~x.endswith(":") & F.concat_ws(" ", x, F.get(lines, i + 1)).rlike(ATTRIBUTION)
        header = x.rlike(FROM_LINE) & near(i, range(1, FOLLOW_UP + 1), AFTER_FROM)
        begun = x.rlike(SIGNATURE) | x.rlike(ORIGINAL) | x.rlike(ATTRIBUTION) | wrapped | header
        return F.when(begun & ~near(i, range(-FORWARD_HEADER, 1), FORWARDED), i)

    return F.coalesce(F.array_min(F.transform(lines, begins)), F.size(lines))


def history_starts(bodies: DataFrame) -> DataFrame:
    """``(id, start)`` of ``bodies(id, text)``: history_start() with a row for each line, for bodies that no task should hold as an array of lines.

    Each line looks at a few lines around it (its four followers, and a forward marker within the eight before), so conditions are
    windows that stream over a body's lines in order; the first line that begins the history is a partial minimum. Null bodies have no start.
    """
    lines = bodies.where("text is not null").select("id", F.posexplode(F.split("text", "\n")).alias("i", "x"))
    at = Window.partitionBy("id").orderBy("i")
    marked = lines.select("*", F.last(F.when(F.col("x").rlike(FORWARDED), F.col("i")), ignorenulls=True).over(at.rowsBetween(-FORWARD_HEADER, 0)).alias("marker"), F.lead("x").over(at).alias("following"), F.max(F.col("x").rlike(AFTER_FROM)).over(at.rowsBetween(1, FOLLOW_UP)).alias("header_goes_on"))
    x = F.col("x")
    wrapped = ~x.endswith(":") & F.concat_ws(" ", x, "following").rlike(ATTRIBUTION)
    header = x.rlike(FROM_LINE) & F.coalesce("header_goes_on", F.lit(False))
    begins = F.col("marker").isNull() & (x.rlike(SIGNATURE) | x.rlike(ORIGINAL) | x.rlike(ATTRIBUTION) | wrapped | header)
    return marked.groupBy("id").agg(F.coalesce(F.min(F.when(begins, F.col("i"))), F.count("*").cast("int")).alias("start"))


def clean_body(text: Column) -> Column:
    """Clean lines up to the history, without quoted ones; at most one empty line in a row."""
    plain = reduce(lambda x, c: F.replace(x, F.lit(c), F.lit("")), INVISIBLE[1:-1], F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))
    lines = F.transform(F.split(plain, "\n"), lambda x: strip(F.regexp_replace(x, SPACES, " ")))
    kept = bound(lines, lambda x: drop_quoted_lines(F.slice(x, F.lit(1), history_start(x))))
    return strip(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n"))


def truncate_text(text: Column, limit: int = 2000) -> Column:
    """At most ``limit`` characters and an ellipsis, cut at the last space if that lies in the second half."""
    head = F.substring(text, 1, limit)
    space = F.instr(F.reverse(head), " ")
    cut = F.when((space > 0) & (F.lit(limit) - space > limit // 2), F.lit(limit) - space).otherwise(F.lit(limit))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(F.substring(head, F.lit(1), cut), r"(?U)\s+$", ""), F.lit(" …")))


class _Text(HTMLParser):
    """Text nodes outside scripts, styles, heads, titles and quotations."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self._open, self._skipped = [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        classes = (dict(attrs).get("class") or "").split()
        skip = tag in ("script", "style", "head", "title", "blockquote") or tag == "div" and bool({"gmail_quote", "gmail_extra"} & set(classes))
        self._open.append((tag, skip))
        self._skipped += skip

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self._open):
            while self._open:
                t, skip = self._open.pop()
                self._skipped -= skip
                if t == tag:
                    break

    def handle_data(self, data):
        if not self._skipped:
            self.parts.append(data)


def text_of_html(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    return "\n".join(parser.parts)


@F.pandas_udf(T.StringType())
def html_to_text(html: pd.Series) -> pd.Series:
    return html.map(text_of_html)


def detect_language(text: Column) -> Column:
    """``en`` if there are more English stop words than German ones, else ``de``."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-zäöüß]+"), F.lit(0))
    count = lambda of: F.size(F.filter(words, lambda w: w.isin(*of)))
    return F.when(count(ENGLISH) > count(GERMAN), "en").otherwise("de")


def render_email() -> Column:
    """A message as text for a judge, from ``date, sender, direct, recipients, is_list, attachments, subject, text``; empty counts as missing."""
    full = lambda c, default: F.when(F.length(c) > 0, F.col(c)).otherwise(default)
    yes = lambda c, no: F.when(F.col(c), "ja").otherwise(no)
    # The lines as judges know them.
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Datum: "), full("date", "unbekannt")),
        F.concat(F.lit("Von: "), full("sender", "unbekannt")),
        F.concat(F.lit("An mich direkt: "), yes("direct", "nein (Kopie/Verteiler)")),
        F.concat(F.lit("Empfänger insgesamt: "), F.coalesce(F.col("recipients").cast("string"), F.lit("None"))),
        F.concat(F.lit("Verteiler/Newsletter-Kopfzeile: "), yes("is_list", "nein")),
        F.concat(F.lit("Anhänge: "), F.coalesce(F.col("attachments").cast("string"), F.lit("None"))),
        F.concat(F.lit("Betreff: "), full("subject", "")),
        F.lit(""),
        full("text", "(kein Text)"),
    )


def recipient_flags(to: str, cc: str, own: Column) -> tuple[Column, Column]:
    """Number of all recipients, and whether the own address is among the direct ones."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return size(to) + size(cc), F.coalesce(F.exists(to, lambda m: m.addr == own), F.lit(False))
