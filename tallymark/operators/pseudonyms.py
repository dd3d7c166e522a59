"""Pseudonyms that stay the same over a whole corpus of messages.

``mails``: ``(id, position, sender struct<name,addr>, to array, cc array, subject, body)``; ``position`` orders
the corpus. Ids are relations, not a dictionary on the driver: mentions with positions, the first position
of each key, and numbers over distinct keys only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions import names, spans
from tallymark.functions.storage import materialized, numbered
from tallymark.functions.workers import held
from tallymark.functions.text import detect_language
from tallymark.operators.votes import draw_sample

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))
MAILBOX = "struct<name:string,addr:string>"
ME = "[ICH]"


def infer_identity(mails: DataFrame) -> tuple[str | None, str | None]:
    """The most frequent recipient's address, and its most frequent name; ties go to the one seen first."""
    each = mails.select("position", F.posexplode(F.concat("to", "cc")).alias("n", "m")).select(F.struct("position", "n").alias("at"), "m.*")
    first = lambda df: df.orderBy(F.desc("count"), "first").limit(1).collect()
    addr = first(each.groupBy("addr").agg(F.count("*").alias("count"), F.min("at").alias("first")))
    if not addr:
        return None, None
    own = each.where((F.col("addr") == addr[0].addr) & (F.length("name") > 0)).groupBy(names.normalize_name(F.col("name")).alias("name")).agg(F.count("*").alias("count"), F.min("at").alias("first"))
    name = first(own)
    return addr[0].addr, name[0]["name"] if name else None


def header_mentions(mails: DataFrame, own_addr: str | None) -> DataFrame:
    """``(at, tokens)`` for people in headers, sender first, then direct recipients, then copies."""
    boxes = F.concat(F.array("sender"), F.coalesce("to", F.array().cast(f"array<{MAILBOX}>")), F.coalesce("cc", F.array().cast(f"array<{MAILBOX}>")))
    each = mails.select("position", F.posexplode(boxes).alias("n", "m")).where("m is not null")
    people = each.where(~F.col("m.addr").eqNullSafe(F.lit(own_addr)) & names.looks_like_person(F.col("m.name"), F.col("m.addr")))
    return people.select(F.struct(F.lit(0).alias("step"), "position", F.col("n").alias("field"), F.lit(0).alias("start")).alias("at"), names.name_tokens(names.normalize_name(F.col("m.name"))).alias("tokens"))


def person_ids(mentions: DataFrame, own_tokens: list[str]) -> DataFrame:
    """``(key, person_id)`` for every distinct name key in ``mentions(at, tokens)``.

    A key of several tokens has an id of its own; a single token takes the id of the first key that has
    it. Mentions without tokens and those of the owner get none. Ids follow first positions.
    """
    rows = mentions.where(F.size("tokens") > 0)
    if own_tokens:
        rows = rows.where(F.size(F.array_except("tokens", F.array(*map(F.lit, own_tokens)))) > 0)
    keys = materialized(rows.groupBy(F.array_join("tokens", " ").alias("key"), "tokens").agg(F.min("at").alias("first")))
    owners = keys.select("key", "first", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.min_by("key", "first").alias("owner"))
    owned = keys.join(owners, keys["key"] == owners["token"], "left").select("key", "first", F.when(F.size("tokens") > 1, F.col("key")).otherwise(F.col("owner")).alias("owner"))
    own = owned.where("key = owner").select("key", "first")
    ids = numbered(own, [F.col("first"), F.col("key")], "person_id").select(F.col("key").alias("owner"), F.col("person_id").cast("long").alias("person_id"))
    return owned.join(ids, "owner").select("key", "person_id")


def mask_domains(domains: DataFrame, tokens: DataFrame) -> DataFrame:
    """``(domain, has_name, shown)`` of distinct domains against ``tokens(token)``.

    Tokens are matched by substrings of the labels, an equi-join that grows with the domains and not
    with domains times tokens. All tokens count, wherever in the corpus they were first seen.
    """
    labels = F.split(F.lower("domain"), r"\.")
    parts = domains.select("domain", F.explode(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0)))).alias("x")).where(F.length("x") >= names.MIN_TOKEN)
    starts = parts.select("domain", "x", F.explode(F.sequence(F.lit(1), F.length("x") - names.MIN_TOKEN + 1)).alias("i"))
    pieces = starts.select("domain", F.explode(F.transform(F.sequence(F.lit(names.MIN_TOKEN), F.length("x") - F.col("i") + 1), lambda n: F.substring("x", F.col("i"), n))).alias("token")).distinct()
    hit = pieces.join(tokens.select("token").distinct(), "token", "left_semi").select("domain").distinct().withColumn("has_name", F.lit(True))
    got = domains.select("domain").distinct().join(hit, "domain", "left").withColumn("has_name", F.coalesce("has_name", F.lit(False)))
    return got.withColumn("shown", F.when(F.col("has_name") & ~names.is_freemail(F.col("domain")), "[DOMAIN]").otherwise(F.col("domain")))


def email_ids(mentions: DataFrame, domains: DataFrame, own_addr: str | None) -> DataFrame:
    """``(addr, placeholder)`` for ``mentions(at, addr)`` in lower case: own, kept role address, or a number and the shown domain."""
    local, domain = F.substring_index("addr", "@", 1), F.substring(F.col("addr"), F.instr("addr", "@") + 1, F.length("addr"))
    keys = mentions.groupBy("addr").agg(F.min("at").alias("first")).withColumn("domain", domain).join(domains, "domain", "left")
    keys = keys.withColumn("own", F.col("addr").eqNullSafe(F.lit(own_addr))).withColumn("kept", ~names.is_freemail(F.col("domain")) & names.is_role(local) & ~F.coalesce("has_name", F.lit(False)))
    keys = materialized(keys)
    number = numbered(keys.where("not own and not kept").select("addr", "first"), [F.col("first"), F.col("addr")], "n").select("addr", "n")
    shown = F.when(F.col("own"), ME).when(F.col("kept"), F.col("addr")).otherwise(F.concat(F.lit("[EMAIL_"), F.col("n").cast("string"), F.lit("]@"), F.coalesce("shown", "domain")))
    return keys.join(number, "addr", "left").select("addr", shown.alias("placeholder"))


def url_host(url: Column) -> Column:
    """Lower-case host without port, user and ``www.``; null if there is none."""
    full = F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("http://"), url))
    host = F.regexp_extract(full, r"^[^:]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    host = F.regexp_replace(F.lower(host), r"^www\.", "")
    return F.when(F.length(host) > 0, host)


#: Known name tokens up to so many bytes together go to every task; more are joined with the texts' words.
MAX_HELD_TOKENS = 16_000_000
_PLACE = "array<struct<start:int,end:int>>"


def name_matches(texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """``(id, field, places)``: where words of ``texts(id, field, text)`` are ``tokens(token)``.

    Every place where a name could stand is a row with its offsets and its word, joined with the tokens and brought back
    as offsets, so texts are not searched again. Names have as many words between apostrophes as the longest token.
    """
    known = tokens.select(F.lower("token").alias("token")).where(F.length("token") >= names.MIN_TOKEN).distinct()
    most = known.agg(F.max(F.size(F.split("token", "['’]")))).first()[0] or 0

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            each = [[(a, b, t[a:b].lower()) for a, b in spans.name_places(t, most)] if t else [] for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "field": pdf["field"], "w": each})

    word = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("token", T.StringType())]))
    rows = texts.select("id", "field", "text").mapInPandas(words, T.StructType([texts.schema["id"], texts.schema["field"], T.StructField("w", word)]))
    hits = rows.select("id", "field", F.inline("w")).join(known, "token")
    return hits.groupBy("id", "field").agg(F.collect_list(F.struct("start", "end")).alias("places"))


def known_names(texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """``(id, field, start, end)`` of known names in ``texts(id, field, text)``, by the match join."""

    @F.pandas_udf(_PLACE)
    def chosen(text: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([[(s.start, s.end) for s in spans.known_at(t, [(p["start"], p["end"]) for p in x])] for t, x in zip(text, places, strict=True)])

    found = texts.select("id", "field", "text").join(name_matches(texts, tokens), ["id", "field"])
    return found.select("id", "field", F.inline(chosen("text", "places")))


def find_spans(texts: DataFrame, tokens: DataFrame, recognized: DataFrame | None = None, held_bytes: int = MAX_HELD_TOKENS) -> DataFrame:
    """Adds ``spans`` to ``texts(id, field, text)``.

    Known name tokens of a measured size of up to ``held_bytes`` are broadcast and looked up where the texts lie; beyond that, the texts'
    words are joined with them (``name_matches``), with the same spans. ``recognized(id, field, found)`` are spans of an external recognizer.
    """
    size = tokens.agg(F.coalesce(F.sum(F.octet_length("token") + 60), F.lit(0))).first()[0]
    rows = texts
    if held := size <= held_bytes:
        known = texts.sparkSession.sparkContext.broadcast(frozenset(r[0].lower() for r in tokens.select("token").distinct().collect() if r[0]))
        rows = rows.withColumn("places", F.lit(None).cast(_PLACE))
    else:
        known = None
        rows = rows.join(name_matches(texts, tokens), ["id", "field"], "left").withColumn("places", F.coalesce("places", F.array().cast(_PLACE)))
    rows = rows.join(recognized, ["id", "field"], "left") if recognized is not None else rows.withColumn("found", F.lit(None).cast(_PLACE))
    rows = rows.withColumn("found", F.filter("found", lambda x: spans.plausible(F.substr("text", x.start + 1, x.end - x.start))))

    @F.pandas_udf(SPANS)
    def spans_of(text: pd.Series, places: pd.Series, found: pd.Series) -> pd.Series:
        pairs = lambda x: [(p["start"], p["end"]) for p in x] if x is not None else []
        tokens = known.value if held else frozenset()
        return pd.Series([[tuple(s) for s in spans.find(t, tokens, pairs(f), None if held else pairs(p))] for t, p, f in zip(text, places, found, strict=True)])

    return rows.withColumn("spans", spans_of("text", "places", "found")).drop("places", "found")


def rewritten(texts: DataFrame, shown: DataFrame) -> DataFrame:
    """``texts(id, field, text)`` with placeholders from ``shown(id, field, start, end, shown)``, a row for each span; texts without spans are left out."""
    places = shown.groupBy("id", "field").agg(F.array_sort(F.collect_list(F.struct("start", "end", "shown"))).alias("p"))
    last = lambda i: F.when(i > 0, F.get("p", i - 1)["end"]).otherwise(0)
    pieces = F.transform("p", lambda x, i: F.concat(F.substring(F.col("text"), last(i) + 1, x.start - last(i)), x.shown))
    tail = F.substring(F.col("text"), F.element_at("p", -1)["end"] + 1, F.length("text"))
    return texts.join(places, ["id", "field"]).select("id", "field", F.concat(F.array_join(pieces, ""), tail).alias("text"))


def owner_of(mails: DataFrame, own_addr: str | None) -> tuple[str | None, str | None]:
    """The owner's address and name: as told, or inferred; a name is known only for the inferred address."""
    addr, name = infer_identity(mails)
    if own_addr:
        return own_addr.lower(), name if own_addr.lower() == addr else None
    return addr, name


def header_names(mails: DataFrame, own_addr: str | None = None) -> tuple[str | None, list[str], DataFrame, DataFrame]:
    """The owner's address and name tokens, people in headers, and the known ``tokens(token)``: those of people in headers and of the owner."""
    own, own_name = owner_of(mails, own_addr)
    spark = mails.sparkSession
    own_tokens = spark.createDataFrame([(own_name or "",)], "n string").select(names.name_tokens(names.normalize_name(F.col("n")))).first()[0]
    header = materialized(header_mentions(mails, own))
    tokens = header.select(F.explode("tokens").alias("token"))
    if own_tokens:
        tokens = tokens.unionByName(spark.createDataFrame([(t,) for t in own_tokens], "token string"))
    return own, own_tokens, header, materialized(tokens.distinct())


def anonymize_corpus(mails: DataFrame, own_addr: str | None = None, recognized: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Messages with placeholders, and counts of replacements by kind.

    Gives ``(id, date, sender, direct, recipients, is_list, attachments, subject, text)``, what render_email()
    takes; date, is_list and attachments are null where ``mails`` has no such column. Two passes: people known from headers
    first, then all texts. Domains are masked by all tokens, whatever their position. Texts are joined once, spans travel without them.
    """
    own, own_tokens, header, tokens = header_names(mails, own_addr)
    person = names.looks_like_person(F.col("sender.name"), F.col("sender.addr"))
    fields = F.explode(F.array(F.struct(F.lit(1).alias("field"), F.when(~person, F.col("sender.name")).alias("text")), F.struct(F.lit(2).alias("field"), F.col("subject").alias("text")), F.struct(F.lit(3).alias("field"), F.col("body").alias("text"))))
    texts = mails.select("id", "position", fields.alias("x")).select("id", "position", "x.*").where(F.length("text") > 0)
    marked = materialized(find_spans(texts, tokens, recognized))
    valued = F.transform("spans", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"), F.substr("text", s.start + 1, s.end - s.start).alias("value")))
    each = marked.select("id", "position", "field", F.explode(valued).alias("s")).select("id", "position", "field", "s.*")
    at = F.struct(F.lit(1).alias("step"), "position", "field", "start")
    each = materialized(each.select("*", at.alias("at"), names.name_tokens(names.normalize_name(F.col("value"))).alias("tokens")))
    senders = mails.where("sender is not null").select("id", F.struct(F.lit(1).alias("step"), "position", F.lit(0).alias("field"), F.lit(0).alias("start")).alias("at"), F.lower("sender.addr").alias("addr"), F.col("sender.name").alias("name"), person.alias("person"), names.name_tokens(names.normalize_name(F.coalesce(F.col("sender.name"), F.lit("")))).alias("tokens"))
    mentions = header.unionByName(each.where("kind = 'PERSON'").select("at", "tokens"))
    people = materialized(person_ids(mentions, own_tokens))
    all_tokens = mentions.select(F.explode("tokens").alias("token")).unionByName(tokens).distinct()
    mailed = senders.select("at", "addr").unionByName(each.where("kind = 'EMAIL'").select("at", F.lower("value").alias("addr")))
    hosts = each.where("kind = 'URL'").select(url_host(F.col("value")).alias("domain")).where("domain is not null")
    domains = materialized(mask_domains(mailed.select(F.expr("substring(addr, instr(addr, '@') + 1)").alias("domain")).unionByName(hosts).distinct(), all_tokens))
    addresses = materialized(email_ids(mailed, domains, own))

    def shown_person(df: DataFrame) -> DataFrame:
        mine = F.lit(False) if not own_tokens else F.size(F.array_except("tokens", F.array(*map(F.lit, own_tokens)))) == 0
        got = df.withColumn("key", F.array_join("tokens", " ")).join(people, "key", "left")
        return got.withColumn("shown_person", F.when(F.size("tokens") == 0, "[PERSON]").when(mine, ME).otherwise(F.concat(F.lit("[PERSON_"), F.col("person_id").cast("string"), F.lit("]"))))

    tags = F.create_map(*(F.lit(x) for kv in spans.TAGS.items() for x in kv))
    out = shown_person(each).withColumn("addr", F.when(F.col("kind") == "EMAIL", F.lower("value"))).join(addresses, "addr", "left")
    out = out.withColumn("domain", F.when(F.col("kind") == "URL", url_host(F.col("value")))).join(domains, "domain", "left")
    url = F.when(F.col("domain").isNotNull(), F.concat(F.lit("[URL:"), F.coalesce("shown", "domain"), F.lit("]"))).otherwise("[URL]")
    pieces = out.select("id", "field", "start", "end", F.when(F.col("kind") == "PERSON", F.col("shown_person")).when(F.col("kind") == "EMAIL", F.col("placeholder")).when(F.col("kind") == "URL", url).otherwise(tags[F.col("kind")]).alias("shown"))
    new = rewritten(marked.select("id", "field", "text"), pieces).groupBy("id").agg(*(F.max(F.when(F.col("field") == i, F.col("text"))).alias(f"new_{i}") for i in (1, 2, 3)))
    sent = shown_person(senders).join(addresses, "addr", "left").select("id", F.col("placeholder").alias("from_addr"), "shown_person", "name", "person")
    both = mails.join(new, "id", "left").join(sent, "id", "left")
    size = F.coalesce(F.size("to"), F.lit(0)) + F.coalesce(F.size("cc"), F.lit(0))
    kept = lambda name, kind: (F.col(name) if name in mails.columns else F.lit(None)).cast(kind).alias(name)
    records = both.select("id", kept("date", "string"), format_sender().alias("sender"), F.coalesce(F.exists("to", lambda m: m.addr == F.lit(own)), F.lit(False)).alias("direct"), size.alias("recipients"), kept("is_list", "boolean"), kept("attachments", "int"), F.coalesce("new_2", "subject").alias("subject"), F.coalesce("new_3", "body").alias("text"))
    return records, replacement_stats(marked)


def format_sender() -> Column:
    """Pseudonym and address of a sender; other names with what was found in them replaced."""
    name = F.when(F.col("person"), F.col("shown_person")).otherwise(F.coalesce("new_1", "name"))
    return F.when(F.length("name") > 0, F.format_string("%s <%s>", name, F.col("from_addr"))).otherwise(F.col("from_addr"))


def replacement_stats(marked: DataFrame) -> DataFrame:
    return marked.select(F.explode("spans.kind").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def residual_audit(records: DataFrame, columns: tuple[str, ...] = ("sender", "subject", "text")) -> DataFrame:
    """Patterns left over after replacing, ``(kind, n)`` for four kinds, zeros included; kept role addresses don't count."""
    text = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in columns))
    hits = lambda kind: F.regexp_extract_all("t", F.lit("(?U)" + spans.PATTERNS[kind].pattern), F.lit(0))
    digits = lambda x: F.regexp_replace(x, r"(?U)\D", "")
    mail = F.filter(hits("EMAIL"), lambda x: names.is_freemail(F.lower(F.substring_index(x, "@", -1))) | ~names.is_role(F.substring_index(x, "@", 1)))
    kept = {
        "EMAIL": mail,
        "IBAN": F.filter(hits("IBAN"), lambda x: F.length(digits(x)) >= 10),
        "PHONE": F.filter(hits("PHONE"), lambda x: F.length(digits(x)) >= 7),
        "CARD": F.filter(hits("CARD"), lambda x: F.length(digits(x)).between(13, 19) & F.call_function("luhn_check", digits(x))),
    }
    sums = records.select(text.alias("t")).select(*(F.size(v).alias(k) for k, v in kept.items())).agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in kept))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in kept))).alias("x")).select("x.*")


def prepare_summary(records: DataFrame, stats: DataFrame, residual: DataFrame, unreadable: int = 0, tokens: DataFrame | None = None) -> DataFrame:
    """One row: files, unreadable ones, written messages, those without text, known name tokens (null if not given), replaced and left-over patterns as maps."""
    as_map = lambda df, n: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias(n))
    row = records.agg(F.count("*").alias("written"), F.count_if(F.coalesce(F.length("text"), F.lit(0)) == 0).alias("without_text")).withColumn("unreadable", F.lit(unreadable)).withColumn("files", F.col("written") + F.col("unreadable"))
    known = tokens.agg(F.count("*").alias("known_tokens")) if tokens is not None else records.sparkSession.createDataFrame([(None,)], "known_tokens long")
    return row.join(F.broadcast(known)).join(F.broadcast(as_map(stats, "replaced"))).join(F.broadcast(as_map(residual, "residual")))


def mark_placeholders(text: Column) -> Column:
    """HTML with escaped text and placeholders marked."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.regexp_replace(text, r"(\[[A-Z_]+(?:_[0-9]+)?(?::[^\]]*)?\])", "<mark>$1</mark>")


def review_sample(originals: DataFrame, records: DataFrame, n: int, seed: int, columns: tuple[str, ...] = ("subject", "text")) -> DataFrame:
    """``n`` drawn records, always the same for a seed, beside their originals: ``<column>_before`` and ``<column>_after``, as HTML with placeholders marked."""
    some = draw_sample(records.select("id", *columns), n, seed, columns).select("id", *(F.col(c).alias(f"{c}_after") for c in columns))
    both = originals.select("id", *(F.col(c).alias(f"{c}_before") for c in columns)).join(some, "id")
    return both.select("id", *(mark_placeholders(F.col(f"{c}_{side}")).alias(f"{c}_{side}") for c in columns for side in ("before", "after")))


Recognizer = Callable[[list[str]], list[list[tuple[int, int]]]]


def name_spans(texts: DataFrame, recognize: Recognizer | dict[str, Recognizer], batch: int = 64) -> DataFrame:
    """``name_spans_held`` with recognizers that need no opening."""
    opened = {k: (lambda f=f: f) for k, f in recognize.items()} if isinstance(recognize, dict) else lambda: recognize
    return name_spans_held(texts, opened, batch)


def name_spans_held(texts: DataFrame, open_recognizer: Callable[[], Recognizer] | dict[str, Callable[[], Recognizer]], batch: int = 64) -> DataFrame:
    """Runs an external recognizer over ``texts(id, field, text)`` in lists of ``batch``; gives ``(id, field, found)``.

    Recognizers are opened in the workers and stay open there. With several by language, texts are dealt by ranges of (language, id), so a
    task has one language, two at a bound, and a worker holds one recognizer at a time; texts of other languages get no spans. A
    recognizer that gives another number of results than it got texts ends the job.
    """
    by_language, key = isinstance(open_recognizer, dict), uuid.uuid4().hex
    rows = texts.select("id", "field", "text", (detect_language(F.coalesce("text", F.lit(""))) if by_language else F.lit("")).alias("lang"))
    if by_language:
        order = ["lang", F.xxhash64("id", "field")]
        rows = rows.repartitionByRange(*order).sortWithinPartitions("lang")

    def spans_of(lang: str, part: list[str]) -> list[list[tuple[int, int]]]:
        open_ = open_recognizer.get(lang) if by_language else open_recognizer
        if open_ is None:
            return [[] for _ in part]
        found = held(f"{key} {lang}", open_)(part)
        if len(found) != len(part):
            raise RuntimeError(f"a recognizer gave {len(found)} results for {len(part)} texts")
        return found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, rows in pdf.groupby("lang", sort=False):
                listed = rows["text"].fillna("").tolist()
                found = [x for i in range(0, len(listed), batch) for x in spans_of(lang, listed[i : i + batch])]
                yield pd.DataFrame({"id": rows["id"], "field": rows["field"], "found": [[{"start": a, "end": b} for a, b in x] for x in found]})

    schema = T.StructType([texts.schema["id"], texts.schema["field"], T.StructField("found", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
    return rows.mapInPandas(run, schema)
