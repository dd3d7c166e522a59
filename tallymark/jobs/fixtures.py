"""The library's tables as views of the star-schema test tables; the same SQL serves Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions.labels import FIELDS
from tallymark.operators import votes

JUDGES = ("j0", "j1", "j2")
#: Dollars for a million tokens, in and out.
PRICES = {"j0": (2.0, 10.0), "j1": (3.0, 15.0), "j2": (1.0, 5.0), "primary": (0.1, 0.0), "fallback": (0.25, 2.0)}
FAMILIES = {"gen_a": "family_1", "gen_b": "family_2", "gen_c": "family_3"}
CATEGORIES = ("personal", "appointment", "billing", "notification", "newsletter", "other")


def _pick(index: str, names: tuple[str, ...]) -> str:
    return f"case {index} " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(names)) + " end"


_PRICE = "case model " + " ".join(f"when '{m}' then (tokens_in * {i} + tokens_out * {o}) / 1e6" for m, (i, o) in PRICES.items()) + " end"

#: {k}: the number in props; {div}: integer division.
LOG = f"""
select *, {_PRICE} as cost_usd from (
  select event_id as seq, id, model, run, user_id, failed, k, latency_ms, 400 + k as tokens_in, 20 + k % 10 as tokens_out,
    case when id % 3 = 0 then 'real' else 'synthetic' end as dataset,
    case when failed then (case when k % 2 = 0 then 'HTTP 429: overload' else 'Schema: urgency' end) end as error,
    case when not failed then {_pick("(id + (case when k % 4 = 0 then 1 else 0 end)) % 3", ("now", "soon", "later"))} end as urgency,
    case when not failed then {_pick("(id + (case when k % 5 = 0 then 1 + k % 3 else 0 end)) % 6", CATEGORIES)} end as category,
    case when not failed then (id % 2 = 0) <> (k % 6 = 0) end as reply_needed,
    case when not failed then (id % 11 = 0) <> (k % 9 = 0) end as phishing
  from (
    select *, event_id {{div}} 8 as id, event_type = 'error' and k % 3 = 0 as failed,
      {_pick("(event_id % 8)", ("j0", "j1", "j2", "primary", "primary", "fallback", "fallback", "primary"))} as model,
      case when event_id % 8 in (4, 6) then 2 else 1 end as run
    from (select event_id, user_id, event_type, value as latency_ms, cast({{k}} as bigint) as k from {{events}})
  )
)
"""
LOG_SQL = LOG.format(div="//", k="json_extract_string(props, '$.k')", events="events")

INTENT = f"id, {_pick('(id % 3)', ('now', 'soon', 'later'))} as urgency, {_pick('(id % 6)', CATEGORIES)} as category, id % 2 = 0 as reply_needed, id % 11 = 0 as phishing"


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All logged calls, with ``answer`` null for failed ones, and certainty maps."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", "props")
    log = spark.sql(LOG.format(div="div", k="get_json_object(props, '$.k')", events="{events}"), events=events)
    answer = F.when(~F.col("failed"), F.struct(*(f.name for f in FIELDS)))
    confidence = F.create_map(F.lit("urgency"), F.col("k") / 100.0, F.lit("category"), (F.col("k") * 37 % 100) / 100.0)
    noul = F.create_map(F.lit("reply_needed"), (F.col("k") * 53 % 100) / 100.0, F.lit("phishing"), (F.col("k") * 71 % 100) / 100.0)
    return log.select("seq", "dataset", "model", "id", "run", "user_id", answer.alias("answer"), "error", "latency_ms", "tokens_in", "tokens_out", "cost_usd", confidence.alias("confidence"), noul.alias("noul"))


def candidates(log: DataFrame) -> DataFrame:
    return log.where(~F.col("model").isin(*JUDGES))


def judges(log: DataFrame) -> DataFrame:
    return log.where(F.col("model").isin(*JUDGES))


def judge_answers(log: DataFrame) -> DataFrame:
    return judges(log).where("answer is not null").groupBy("id", "model").agg(F.max("seq").alias("seq"), F.max_by("answer", "seq").alias("answer"))


def truth(log: DataFrame) -> DataFrame:
    return votes.consensus(judge_answers(log), log.select("id"))


def answers(log: DataFrame) -> DataFrame:
    return votes.latest_answers(candidates(log), ["dataset", "model", "id", "run"])


def emails(log: DataFrame) -> DataFrame:
    """Generator and intended labels of each message."""
    gen = F.element_at(F.array(*map(F.lit, FAMILIES)), (F.col("user_id") % 3 + 1).cast("int"))
    base = log.where("seq % 8 = 0").select("id", gen.alias("generator"))
    return base.selectExpr(*[f"{x}" for x in ("id", "generator")], f"named_struct('urgency', {_pick('(id % 3)', ('now', 'soon', 'later'))}, 'category', {_pick('(id % 6)', CATEGORIES)}, 'reply_needed', id % 2 = 0, 'phishing', id % 11 = 0) as intent")


def _long(source: str, columns: str, name: str) -> str:
    part = lambda f: f"select {columns}, '{f.name}' as field, " + (f"'\"' || {f.name} || '\"'" if f.kind == "string" else f"cast({f.name} as varchar)") + f" as {name} from {source}"
    return " union all ".join(map(part, FIELDS))


_ALL = ", ".join(f"arg_max({f.name}, seq) as {f.name}" for f in FIELDS)
_KNOWN = "bool_and(actual is not null)"

#: Common tables of the checking SQL: log, last (latest answers), votes, truth (by field), whole (complete ids), p (pairs), flags.
CTES = f"""with log as ({LOG_SQL}),
cand as (select * from log where model not in ('j0','j1','j2')),
last as (select dataset, model, id, run, {_ALL} from cand where not failed group by all),
judged as (select id, model, max(seq) as seq, {_ALL} from log where model in ('j0','j1','j2') and not failed group by all),
votes as ({_long("judged", "id, model, seq", "label")}),
counted as (select id, field, label, count(*) as n, min(seq) as first from votes group by all),
top as (select id, field, arg_max(label, n * 1000000000 - first) as label, max(n) as n from counted group by all),
fields as (select unnest([{", ".join(f"'{f.name}'" for f in FIELDS)}]) as field),
truth as (select i.id, f.field, coalesce(t.n, 0) as n, case when t.n >= 2 then t.label end as actual
  from (select distinct id from log) i cross join fields f left join top t on t.id = i.id and t.field = f.field),
whole as (select id from truth group by id having {_KNOWN}),
long as ({_long("last", "dataset, model, id, run", "pred")}),
p as (select l.dataset, l.model, l.id, l.run, l.field, l.pred, t.actual from long l join truth t on t.id = l.id and t.field = l.field where t.actual is not null),
flags as (select dataset, model, id, run, bool_and(pred = actual) as correct from p where id in (select id from whole) group by all)
"""
