"""Queries over messages made of the test tables: selection, cleaning, pseudonyms, samples, synthetic specs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions import names, text
from tallymark.operators import mailbox, pseudonyms, synth, votes

QUERIES, ORACLES = {}, {}
OWN = "me@home.example"
_ORDERS = "select *, case when o_orderkey % 17 = 0 then '' else cast(o_custkey as varchar) end as message_id, case when o_orderkey % 19 = 0 then null else o_orderdate end as received from orders"
_BLOCKED = "select cast(o_custkey as varchar) from orders where o_orderstatus = 'P' and o_orderpriority = '1-URGENT'"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.withColumn("message_id", F.when(F.col("o_orderkey") % 17 == 0, "").otherwise(F.col("o_custkey").cast("string"))).withColumn("received", F.when(F.col("o_orderkey") % 19 != 0, F.col("o_orderdate")))


def blocked(df: DataFrame) -> DataFrame:
    return df.where("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'").select(F.col("o_custkey").cast("string").alias("message_id"))


@query("select o_orderkey, lower(trim(o_orderpriority)) in ('1-urgent', 'f') or lower(trim(o_orderstatus)) in ('1-urgent', 'f') as excluded from orders")
def exclude_folders(spark, sf_dir):
    return mailbox.exclude_folders(read(spark, sf_dir, "orders").withColumn("mailbox_path", F.array("o_orderpriority", "o_orderstatus")), ["1-Urgent ", "f"]).select("o_orderkey", "excluded")


@query(f"select o_orderkey from ({_ORDERS}) where message_id = '' or message_id not in ({_BLOCKED})")
def blocked_ids(spark, sf_dir):
    m = messages(spark, sf_dir)
    return mailbox.drop_blocked(m, blocked(m)).select("o_orderkey")


_DEDUPED = f"select o_orderkey, received, message_id from ({_ORDERS}) qualify message_id = '' or row_number() over (partition by message_id order by received desc nulls last, o_orderkey) = 1"


@query(f"select o_orderkey, message_id from ({_DEDUPED})")
def dedupe_latest(spark, sf_dir):
    return mailbox.dedupe_latest(messages(spark, sf_dir), "o_orderkey").select("o_orderkey", "message_id")


@query(f"select o_orderkey from ({_DEDUPED}) order by received desc nulls last, o_orderkey limit 100")
def latest_n(spark, sf_dir):
    return mailbox.latest_n(mailbox.dedupe_latest(messages(spark, sf_dir), "o_orderkey"), 100, "o_orderkey").select("o_orderkey")


@query(f"select o_orderkey, lpad(cast(row_number() over (order by received desc nulls last, o_orderkey) as varchar), 4, '0') || '_' || coalesce(strftime(received, '%Y-%m-%d'), 'unbekannt') || '.eml' as file_name from (select * from ({_DEDUPED}) order by received desc nulls last, o_orderkey limit 100)")
def export_names(spark, sf_dir):
    return mailbox.export_names(mailbox.latest_n(mailbox.dedupe_latest(messages(spark, sf_dir), "o_orderkey"), 100, "o_orderkey"), "o_orderkey").select("o_orderkey", "file_name")


@query("select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[​‌‍⁠﻿­͏]', '', 'g'), '[ \t   ]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) as cleaned from documents")
def clean_inline(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_inline(F.col("text"))).alias("cleaned"))


#: Documents as bodies with a history: lines before and after the document's own, by id.
_BODY = "case doc_id % 6 when 0 then text when 1 then text || chr(10) || '-- ' || chr(10) || 'x' when 2 then 'Forwarded message' || chr(10) || 'From: a' || chr(10) || 'Date: b' || chr(10) || text when 3 then 'hi' || chr(10) || 'On 1 Jan, someone' || chr(10) || 'wrote:' || chr(10) || text when 4 then 'From: a' || chr(10) || 'q' || chr(10) || '> z' || chr(10) || 'Sent: b' || chr(10) || text else '> a' || chr(10) || text || chr(10) || '---- Original Message ----' end"


def bodies(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.expr(_BODY.replace("chr(10)", "char(10)")).alias("text"))


def _starts(lines: str) -> str:
    """Common tables of the SQL: ``starts`` has the line at which the history begins, of ``lines(doc_id, x array)``."""
    return f"""l as (select doc_id, x[i] as x, i - 1 as i, x[i + 1] as y, x[i + 1:i + 4] as after, x[greatest(1, i - 8):i] as before from (select doc_id, x, unnest(range(1, len(x) + 1)) as i from ({lines}))),
b as (select doc_id, i from l where len(list_filter(before, lambda z: regexp_matches(z, '(?i)^\\s*-*\\s*(Forwarded message|Weitergeleitete Nachricht|Begin forwarded message|Anfang der weitergeleiteten Nachricht)\\s*:?\\s*-*\\s*$'))) = 0 and (x in ('--', '-- ')
 or regexp_matches(x, '(?i)^\\s*-{{2,}}\\s*(Original Message|Ursprüngliche Nachricht|Originalnachricht)\\s*-{{2,}}\\s*$') or regexp_matches(x, '(?i)^\\s*(Am|On)\\b.{{5,250}}\\b(schrieb|wrote)\\b.*:\\s*$')
 or (x not like '%:' and regexp_matches(concat_ws(' ', x, y), '(?i)^\\s*(Am|On)\\b.{{5,250}}\\b(schrieb|wrote)\\b.*:\\s*$'))
 or (regexp_matches(x, '^\\s*\\*?(Von|From)\\s*:\\*?\\s+\\S') and len(list_filter(after, lambda z: regexp_matches(z, '^\\s*\\*?(Gesendet|Sent|Datum|Date|An|To)\\s*:\\*?\\s'))) > 0))),
n as (select doc_id, max(i) + 1 as n from l group by doc_id),
starts as (select n.doc_id, coalesce(min(b.i), any_value(n.n))::int as start from n left join b using (doc_id) group by n.doc_id)"""


_LINES = f"select doc_id, string_split({_BODY}, chr(10)) as x from documents where text is not null"


@query(f"with {_starts(_LINES)} select doc_id, start from starts")
def history_starts(spark, sf_dir):
    return text.history_starts(bodies(spark, sf_dir).withColumnRenamed("doc_id", "id")).select(F.col("id").alias("doc_id"), "start")


@query(ORACLES["history_starts"])
def history_start(spark, sf_dir):
    return bodies(spark, sf_dir).select("doc_id", text.history_start(F.split("text", "\n")).alias("start"))


_CLEANED = f"select doc_id, list_transform(string_split(regexp_replace(regexp_replace({_BODY}, '\\r\\n?', chr(10), 'g'), '{text.INVISIBLE}', '', 'g'), chr(10)), lambda x: regexp_replace(regexp_replace(x, '{text.SPACES}', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) as x from documents where text is not null"


@query(
    f"""with lines as ({_CLEANED}), {_starts("select doc_id, x from lines")}
select doc_id, md5(regexp_replace(regexp_replace(array_to_string(list_filter(x[1:start], lambda y: not regexp_matches(y, '^\\s*>')), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) as body from lines join starts using (doc_id)"""
)
def clean_body(spark, sf_dir):
    return bodies(spark, sf_dir).select("doc_id", F.md5(text.clean_body(F.col("text"))).alias("body"))


@query(f"select doc_id, len(list_filter(string_split({_BODY}, chr(10)), lambda x: not regexp_matches(x, '^\\s*>'))) as n from documents where text is not null")
def drop_quoted_lines(spark, sf_dir):
    return bodies(spark, sf_dir).select("doc_id", F.size(text.drop_quoted_lines(F.split("text", "\n"))).cast("long").alias("n"))


_CUT = "(2000 - strpos(reverse(left(text, 2000)), ' '))"
_TRUNCATED = f"case when length(text) <= 2000 then text else regexp_replace(left(text, case when strpos(reverse(left(text, 2000)), ' ') > 0 and {_CUT} > 1000 then {_CUT} else 2000 end), '\\s+$', '') || ' …' end"


@query(f"select doc_id, md5({_TRUNCATED}) as body from documents")
def truncate_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.truncate_text(F.col("text"))).alias("body"))


@query()
def html_to_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.html_to_text("html").alias("text"))


_COUNT = lambda words: f"len(list_filter(w, lambda x: x in ({', '.join(repr(x) for x in words)})))"


@query(f"select doc_id, case when {_COUNT(text.ENGLISH)} > {_COUNT(text.GERMAN)} then 'en' else 'de' end as lang from (select doc_id, regexp_extract_all(lower(text), '[a-zäöüß]+') as w from documents)")
def detect_language(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.detect_language(F.col("text")).alias("lang"))


def mails(spark, sf_dir) -> DataFrame:
    """Documents as parsed messages, with recipients from arithmetic on ids."""
    box = lambda n, a: F.struct(n.alias("name"), a.alias("addr"))
    i = F.col("doc_id")
    me = box(F.lit("Own Er"), F.lit(OWN))
    other = box(F.lit(None).cast("string"), F.concat(F.lit("p"), (i % 7).cast("string"), F.lit("@x.example")))
    sender = box(F.concat(F.lit("Maria Nummer"), F.lit("")), F.concat(F.lit("p"), (i % 11).cast("string"), F.lit("@"), "source", F.lit(".example")))
    return read(spark, sf_dir, "documents").select(
        "doc_id", i.cast("string").alias("id"), i.alias("position"), sender.alias("sender"), F.when(i % 3 == 0, F.array(me, other)).otherwise(F.array(other)).alias("to"), F.when(i % 3 == 1, F.array(me)).otherwise(F.array().cast(f"array<{pseudonyms.MAILBOX}>")).alias("cc"),
        F.substring("text", 1, 60).alias("subject"), F.col("text").alias("body"),
    )


@query("select doc_id, case when doc_id % 3 = 0 then 2 else 1 end + case when doc_id % 3 = 1 then 1 else 0 end as recipients, doc_id % 3 = 0 as direct from documents")
def recipient_flags(spark, sf_dir):
    n, direct = text.recipient_flags("to", "cc", F.lit(OWN))
    return mails(spark, sf_dir).select("doc_id", n.alias("recipients"), direct.alias("direct"))


@query("select doc_id, md5('Datum: unbekannt' || chr(10) || 'Von: ' || source || '.example' || chr(10) || 'An mich direkt: ' || case when doc_id % 3 = 0 then 'ja' else 'nein (Kopie/Verteiler)' end || chr(10) || 'Empfänger insgesamt: ' || cast(doc_id % 4 as varchar) || chr(10) || 'Verteiler/Newsletter-Kopfzeile: ' || case when doc_id % 5 = 0 then 'ja' else 'nein' end || chr(10) || 'Anhänge: 0' || chr(10) || 'Betreff: ' || left(text, 60) || chr(10) || chr(10) || text) as rendered from documents")
def render_email(spark, sf_dir):
    i = F.col("doc_id")
    rows = read(spark, sf_dir, "documents").select("doc_id", F.lit(None).cast("string").alias("date"), F.concat("source", F.lit(".example")).alias("sender"), (i % 3 == 0).alias("direct"), (i % 4).alias("recipients"), (i % 5 == 0).alias("is_list"), F.lit(0).alias("attachments"), F.substring("text", 1, 60).alias("subject"), "text")
    return rows.select("doc_id", F.md5(text.render_email()).alias("rendered"))


@query("select c_custkey, case when c_custkey % 2 = 0 then 'First ' || c_name else c_name end as name from customer")
def normalize_name(spark, sf_dir):
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit(", First "))).otherwise(F.concat(F.lit(' "'), "c_name", F.lit('"')))
    return read(spark, sf_dir, "customer").select("c_custkey", names.normalize_name(raw).alias("name"))


@query()
def looks_like_person(spark, sf_dir):
    return mails(spark, sf_dir).select("doc_id", names.looks_like_person(F.substring_index("subject", " ", 2), F.col("sender.addr")).alias("person"))


@query(
    f"""with boxes as (select doc_id, case when doc_id % 3 = 0 then ['{OWN}', o] when doc_id % 3 = 1 then [o, '{OWN}'] else [o] end as a from (select doc_id, 'p' || doc_id % 7 || '@x.example' as o from documents)),
each as (select doc_id, unnest(a) as addr, generate_subscripts(a, 1) as n from boxes), named as (select *, case when addr = '{OWN}' then 'Own Er' end as name from each),
own as (select addr from named group by addr order by count(*) desc, min(doc_id * 10 + n) limit 1)
select addr, (select name from named where length(name) > 0 and addr = own.addr group by name order by count(*) desc, min(doc_id * 10 + n) limit 1) as name from own"""
)
def infer_identity(spark, sf_dir):
    return spark.createDataFrame([pseudonyms.infer_identity(mails(spark, sf_dir))], "addr string, name string")


#: Every word of every text begins a mention, of one word or of two in turn.
_MENTIONS = """select doc_id * 1000000 + i as pos, case when i % 2 = 1 and next is not null then [word, next] else [word] end as tokens
from (select doc_id, i, word, lead(word) over (partition by doc_id order by i) as next
from (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from (select doc_id, regexp_extract_all(lower(text), '[a-z]{3,}') as w from documents)))"""


@query(
    f"""with m as (select pos, tokens, array_to_string(tokens, ' ') as key from ({_MENTIONS})),
keys as (select key, any_value(tokens) as tokens, min(pos) as first from m group by key),
owners as (select token, arg_min(key, first) as owner from (select key, first, unnest(tokens) as token from keys) group by token),
owned as (select k.key, k.first, case when len(k.tokens) > 1 then k.key else o.owner end as owner from keys k left join owners o on o.token = k.key),
ids as (select key, row_number() over (order by first, key) as person_id from owned where key = owner)
select o.key, i.person_id from owned o join ids i on i.key = o.owner"""
)
def person_ids(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)).alias("w"))
    each = words.select("doc_id", F.posexplode(F.arrays_zip(F.col("w").alias("word"), F.slice("w", F.lit(2), F.size("w")).alias("next"))).alias("i", "x"))
    rows = each.select((F.col("doc_id") * 1_000_000 + F.col("i") + 1).alias("at"), F.when((F.col("i") % 2 == 0) & F.col("x.next").isNotNull(), F.array("x.word", "x.next")).otherwise(F.array("x.word")).alias("tokens"))
    return pseudonyms.person_ids(rows, [])


@query("select page_id, nullif(regexp_replace(lower(regexp_extract(url, '^[^:]*://([^/?#:]*)', 1)), '^www\\.', ''), '') as host from pages")
def url_to_host(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", pseudonyms.url_host(F.col("url")).alias("host"))


_HOSTS = "select distinct regexp_extract(url, '^[^:]*://([^/?#:]*)', 1) as domain from pages"


@query(f"select domain, list_contains(string_split(domain, '.')[:-2], 'example') or domain like '%casino%' as has_name, case when list_contains(string_split(domain, '.')[:-2], 'example') or domain like '%casino%' then '[DOMAIN]' else domain end as shown from ({_HOSTS})")
def mask_domain(spark, sf_dir):
    hosts = read(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[^:]*://([^/?#:]*)", 1).alias("domain"))
    return pseudonyms.mask_domains(hosts, spark.createDataFrame([("casino",), ("exampl",)], "token string"))


_EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.example\\.com"


@query(f"with a as (select lower(unnest(regexp_extract_all(text, '{_EMAIL}'))) as addr, doc_id from documents), k as (select addr, min(doc_id) as first from a group by addr) select addr, '[EMAIL_' || row_number() over (order by first, addr) || ']@' || split_part(addr, '@', 2) as placeholder from k")
def email_ids(spark, sf_dir):
    got = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("at"), F.explode(F.regexp_extract_all("text", F.lit(_EMAIL), F.lit(0))).alias("addr")).withColumn("addr", F.lower("addr"))
    domains = pseudonyms.mask_domains(got.select(F.substring_index("addr", "@", -1).alias("domain")), spark.createDataFrame([], "token string"))
    return pseudonyms.email_ids(got, domains, None)


#: Texts in which every "the", "und", "les" and "los" is a name with parts around apostrophes, and the first words of all texts as known names besides.
_NAMED = "replace(regexp_replace(text, ' (the|und|les|los) ', ' O~Neil~s D~Arc ', 'g'), '~', chr(39))"
_FIRST = "lower(regexp_extract(text, '^[A-Za-z]{3,}'))"


@query(
    f"""with runs as (select doc_id, unnest(x) as run, generate_subscripts(x, 1) as i from (select doc_id, regexp_extract_all({_NAMED}, '[\\p{{L}}\\p{{N}}_\\-]+(?:[\\x27’][\\p{{L}}\\p{{N}}_\\-]+)*|[^\\p{{L}}\\p{{N}}_\\-]+?') as x from documents)),
placed as (select doc_id, run, sum(length(run)) over (partition by doc_id order by i) - length(run) as o from runs),
pieces as (select doc_id, run, o, p, unnest(p) as piece, generate_subscripts(p, 1) as a from (select *, string_split(replace(run, '’', chr(39)), chr(39)) as p from placed where regexp_matches(run, '^[\\p{{L}}\\p{{N}}_\\-]'))),
subs as (select doc_id, o + length(array_to_string(p[1:a - 1], chr(39))) + case when a > 1 then 1 else 0 end as s, substr(run, length(array_to_string(p[1:a - 1], chr(39))) + case when a > 1 then 2 else 1 end, length(array_to_string(p[a:z], chr(39)))) as word
 from (select *, unnest(range(a, least(len(p), a + 1) + 1)) as z from pieces)),
tokens as (select distinct {_FIRST} as token from documents where {_FIRST} <> '' union select unnest(['o' || chr(39) || 'neil', 'neil', 'd' || chr(39) || 'arc', 'arc'])),
hits as (select doc_id, s, s + length(word) as e, word from subs where length(word) >= 3 and lower(word) in (select token from tokens)),
longest as (select doc_id, s, max(e) as e, arg_max(word, e) as word from hits group by doc_id, s)
select doc_id, s::int as "start", e::int as "end" from longest l where regexp_matches(word, '^\\p{{Lu}}') and not exists (select 1 from longest b where b.doc_id = l.doc_id and b.s < l.s and b.e > l.s)"""
)
def find_known_names(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    first = F.lower(F.regexp_extract("text", "^[A-Za-z]{3,}", 0))
    own = spark.createDataFrame([(x,) for x in ("o'neil", "neil", "d'arc", "arc")], "token string")
    tokens = docs.select(first.alias("token")).where("token <> ''").unionByName(own).distinct()
    texts = docs.select(F.col("doc_id").alias("id"), F.lit(0).alias("field"), F.replace(F.regexp_replace("text", " (the|und|les|los) ", " O~Neil~s D~Arc "), F.lit("~"), F.lit("'")).alias("text"))
    places = pseudonyms.known_names(texts, tokens)
    return places.select(F.col("id").alias("doc_id"), "start", "end")


@query()
def find_spans(spark, sf_dir):
    texts = mails(spark, sf_dir).select("id", F.lit("body").alias("field"), F.col("body").alias("text"))
    tokens = spark.createDataFrame([("orre",), ("thing",)], "token string")
    return pseudonyms.find_spans(texts, tokens).select("id", F.explode("spans").alias("s")).select("id", "s.*")


@query()
def anonymize_corpus(spark, sf_dir):
    return pseudonyms.anonymize_corpus(mails(spark, sf_dir))[0]


@query()
def replacement_stats(spark, sf_dir):
    return pseudonyms.anonymize_corpus(mails(spark, sf_dir))[1]


@query()
def residual_audit(spark, sf_dir):
    return pseudonyms.residual_audit(pseudonyms.anonymize_corpus(mails(spark, sf_dir))[0])


@query()
def prepare_summary(spark, sf_dir):
    rows = mails(spark, sf_dir)
    records, stats = pseudonyms.anonymize_corpus(rows)
    return pseudonyms.prepare_summary(records, stats, pseudonyms.residual_audit(records), tokens=pseudonyms.header_names(rows)[-1])


@query()
def draw_sample(spark, sf_dir):
    return votes.draw_sample(mails(spark, sf_dir).select("id", F.col("body").alias("text"), "subject"), 50, 42)


def _marked(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"regexp_replace({x}, '(\\[[A-Z_]+(_[0-9]+)?(:[^\\]]*)?\\])', '<mark>\\1</mark>', 'g')"


_SHOWN = "regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '[EMAIL_1]', 'g')"


@query(f"select doc_id, md5({_marked('text')}) as text_before, md5({_marked(_SHOWN)}) as text_after from documents where length(text) > 0")
def review_sample(spark, sf_dir):
    """All documents are drawn: the two sides of each, with addresses replaced on the second."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    records = docs.withColumn("text", F.regexp_replace("text", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "[EMAIL_1]"))
    got = pseudonyms.review_sample(docs, records, docs.count(), 42, ("text",))
    return got.select(F.col("id").alias("doc_id"), F.md5("text_before").alias("text_before"), F.md5("text_after").alias("text_after"))


def _scenarios(spark, sf_dir) -> DataFrame:
    """Nations as scenarios: weights by key, every fifth one special."""
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("position"), F.col("n_name").alias("key"), (F.col("n_nationkey") % 4 + 1).alias("weight"), (F.col("n_nationkey") % 5 == 0).alias("phishing"))


#: The SQL looks draws up in the same table; a test holds tables against the weights they were made of.
_X = "(((i + 7919 + 5 * 104729 + 1) * 48271) % 2147483647 * 69621 + 1) % 2147483647 * 25"
_SLOTS = ", ".join(f"({a}, {b}, {c})" for a, b, c in synth.alias_table([i % 4 + 1 for i in range(25)]))
_DRAWN = f"""with s as (select n_name as key, n_nationkey % 5 = 0 as phishing, row_number() over (order by n_nationkey) - 1 as at from nation),
slots(slot, own, other) as (values {_SLOTS}), room as (select sum(n_nationkey % 4 + 1) as room from nation),
u as (select i, {_X} // 2147483647 as slot, {_X} % 2147483647 * (select room from room)::bigint // 2147483647 as v from (select row_number() over () - 1 as i from orders)),
d as (select i as row, key, phishing from u join slots using (slot) join s on s.at = case when v < own then slot else other end)"""


@query(_DRAWN + " select row, key from d")
def draw_scenarios(spark, sf_dir):
    return synth.draw_scenarios(spark, read(spark, sf_dir, "orders").count(), _scenarios(spark, sf_dir), 5).select("row", "key")


@query(_DRAWN + " select row, case when phishing then ['x', 'z'][1 + (n - 1) % 2] else ['x', 'y', 'z'][1 + (n - 1) % 3] end as generator from (select *, row_number() over (partition by phishing order by row) as n from d)")
def round_robin_generator(spark, sf_dir):
    drawn = synth.draw_scenarios(spark, read(spark, sf_dir, "orders").count(), _scenarios(spark, sf_dir), 5)
    return synth.round_robin_generator(drawn, ["x", "y", "z"], ["x", "z"]).select("row", "generator")


_U = lambda salt: f"((((row + {salt} * 7919 + 5 * 104729 + 1) * 48271) % 2147483647 * 69621 + 1) % 2147483647 / 2147483647.0)"
_ONE_OF = lambda salt, x: f"{list(x)}[(1 + floor({_U(salt)} * {len(x)}))::int]"


@query(
    _DRAWN
    + f""", a as (select row, key, case when row + 1 < 1000 then 'S' || lpad((row + 1)::varchar, 3, '0') else 'S' || (row + 1) end as id, {_ONE_OF(2, "abc")} as industry, {_ONE_OF(3, ("short", "long"))} as length, {_ONE_OF(4, ("plain", "warm"))} as tone,
case when {_U(5)} < 0.15 then 'englisch' else 'deutsch' end as language, (case key when 'FRANCE' then 3 + floor({_U(8)} * 38) when 'CHINA' then 500 else 1 end)::int as recipients,
timestamp '2026-09-01 08:00:00' + to_days(floor({_U(6)} * 30)::int) + to_minutes(floor({_U(7)} * 601)::int) as sent from d)
select id, industry, length, tone, language, recipients, strftime(sent, '%Y-%m-%d %H:%M:%S') as date, 'Szenario: ' || key || chr(10) || 'Organisation des Empfängers: ' || industry || chr(10) || 'Gesendet ' || case key when 'FRANCE' then 'an andere, ich stehe nur in CC' when 'CHINA' then 'an einen Verteiler' else 'direkt an mich' end
|| '; Datum ' || strftime(sent, '%Y-%m-%dT%H:%M:%S') || chr(10) || 'Länge: ' || length || '; Ton: ' || tone || '; Sprache: ' || language || chr(10) || 'Schreibe genau diese eine E-Mail.' as prompt from a"""
)
def draw_attributes(spark, sf_dir):
    drawn = synth.draw_scenarios(spark, read(spark, sf_dir, "orders").count(), _scenarios(spark, sf_dir), 5).withColumn("description", F.col("key"))
    got = synth.draw_attributes(drawn, 5, ("a", "b", "c"), ("short", "long"), ("plain", "warm"), copies=("FRANCE",), mass=("CHINA",))
    return got.select("id", "industry", "length", "tone", "language", "recipients", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), synth.render_prompt().alias("prompt"))


@query("select conv_id, turn, turn % 3 <> 0 and trim(text) <> '' and trim(role) <> '' as ok from conversations")
def valid_mail(spark, sf_dir):
    raw = F.to_json(F.struct(F.col("role").alias("sender"), F.lit("s").alias("subject"), "text", F.when(F.col("turn") % 3 != 0, 1).alias("attachments")))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", synth.valid_mail(raw).alias("ok"))


@query("select d.doc_id as id from documents d where d.doc_id not in (select doc_id from labels)")
def generation_progress(spark, sf_dir):
    return synth.generation_progress(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") > 0).alias("ok"), F.lit(0.1).alias("cost_usd")))[0]
