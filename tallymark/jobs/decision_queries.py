"""Queries over the decision log, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.labels import FIELDS, long_form
from tallymark.jobs import fixtures as fx
from tallymark.jobs.fixtures import CTES
from tallymark.operators import metrics as m
from tallymark.operators import votes as v

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a function of (spark, decision log, sf_dir) under its name."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, fx.decision_log(spark, sf_dir), sf_dir)
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def pairs_of(log: DataFrame) -> DataFrame:
    return m.pairs(fx.answers(log), fx.truth(log))


def flags_of(log: DataFrame) -> DataFrame:
    return m.message_flags(pairs_of(log))


def prices(spark):
    return spark.createDataFrame([(k, *x) for k, x in fx.PRICES.items()], "model string, usd_in double, usd_out double")


_F = [f.name for f in FIELDS]
_CANDIDATE = "dataset, model"


@query(CTES + "select id, field, n, actual from truth")
def consensus(spark, log, sf_dir):
    return fx.truth(log).select("id", "agreement", long_form("truth", value="actual").alias("x")).select("id", "x.field", F.element_at("agreement", F.col("x.field")).alias("n"), "x.actual")


@query(CTES + "select id, model, run, dataset, field, pred from long")
def latest_answers(spark, log, sf_dir):
    return fx.answers(log).select("id", "model", "run", "dataset", long_form("answer", value="pred").alias("x")).select("id", "model", "run", "dataset", "x.*")


@query(CTES + "select m.model, i.id, r.run from (select distinct model from cand) m cross join (select distinct id from log) i cross join (select unnest([1, 2]) as run) r where not exists (select 1 from cand c where c.model = m.model and c.id = i.id and c.run = r.run and not c.failed)")
def pending_work(spark, log, sf_dir):
    models = spark.createDataFrame([("primary",), ("fallback",)], "model string")
    return v.pending_work(models, log.select("id").distinct(), fx.candidates(log), spark.createDataFrame([(1,), (2,)], "run int"))


@query(CTES + "select seq, model from (select *, coalesce(sum(cost_usd) over (partition by model order by seq rows between unbounded preceding and 1 preceding), 0) as spent from log) where spent < 0.05")
def budget_cutoff(spark, log, sf_dir):
    return v.budget_cutoff(log, 0.05, ["model"]).select("seq", "model")


@query(CTES + "select model, count(*) as calls, round(sum(cost_usd), 6) as logged_cost, round(sum(cost_usd) + arg_min(cost_usd, seq), 6) as cost_with_warmup from log group by model")
def warmup_excluded(spark, log, sf_dir):
    """A warm-up call for each model (here: as dear as its first) is paid for but not among the logged calls."""
    first = log.groupBy("model").agg(F.min_by("cost_usd", "seq").alias("cost_usd")).select("model", F.lit("warmup").alias("id"), "cost_usd")
    calls = log.select("model", F.col("id").cast("string").alias("id"), "cost_usd").unionByName(first)
    logged = v.without_warmup(calls).groupBy("model").agg(F.count("*").alias("calls"), F.round(F.sum("cost_usd"), 6).alias("logged_cost"))
    return logged.join(v.spent(calls).select("model", F.round("cost_usd", 6).alias("cost_with_warmup")), "model")


@query(
    CTES
    + """, given as (select id, 'category' as field, '"other"' as value from log where id % 7 = 0 and seq % 8 = 0 union all select id, 'phishing', 'true' from log where id % 14 = 0 and seq % 8 = 0)
select t.id, t.field, coalesce(g.value, t.actual) as actual, t.n < 2 and g.value is null as is_open, g.value is not null as is_manual from truth t left join given g using (id, field)"""
)
def apply_decisions(spark, log, sf_dir):
    ids = log.where("seq % 8 = 0")
    given = ids.where("id % 7 = 0").select("id", F.lit("category").alias("field"), F.lit("other").alias("value")).unionByName(ids.where("id % 14 = 0").select("id", F.lit("phishing").alias("field"), F.lit("true").alias("value")))
    got = v.apply_decisions(fx.truth(log), given)
    return got.select("id", "open", "manual", long_form("truth", value="actual").alias("x")).select("id", "x.*", F.array_contains("open", F.col("x.field")).alias("is_open"), F.array_contains("manual", F.col("x.field")).alias("is_manual"))


@query(CTES + "select model, count_if(not failed) as ok, count_if(failed) as failed, round(sum(cost_usd), 4) as cost_usd, round(quantile_cont(latency_ms, 0.5) filter (not failed), 0) as latency_p50_ms from log where model in ('j0','j1','j2') group by model")
def judge_stats(spark, log, sf_dir):
    return v.judge_stats(fx.judges(log))


@query(CTES + "select field, count(*) as emails, count_if(n = 3) as unanimous, count_if(actual is not null) as with_majority, count_if(actual is null) as open from truth group by field")
def vote_summary(spark, log, sf_dir):
    return v.vote_summary(fx.truth(log), 3)


@query(CTES + "select count(*) as emails, count_if(o > 0) as emails_open, cast(sum(o) as bigint) as fields_open, (select round(sum(cost_usd), 4) from log where model in ('j0','j1','j2')) as cost_usd from (select id, count_if(actual is null) as o from truth group by id)")
def vote_totals(spark, log, sf_dir):
    return v.vote_totals(fx.truth(log), fx.judges(log))


@query(CTES + "select model, split_part(error, ':', 1) as kind, count(*) as n from log where model in ('j0','j1','j2') and error is not null group by all")
def judge_error_kinds(spark, log, sf_dir):
    return v.error_kinds(fx.judges(log), ["model"])


@query(CTES + "select v.model, v.field, round(count_if(v.label = t.actual) / count(*), 3) as agreement from votes v join truth t using (id, field) where t.actual is not null group by all")
def agreement_with_majority(spark, log, sf_dir):
    return v.agreement_with_majority(fx.judge_answers(log), fx.truth(log))


@query(CTES + "select seq, model, round(cost_usd, 9) as cost_usd from log")
def call_cost(spark, log, sf_dir):
    return v.call_cost(log.drop("cost_usd"), prices(spark)).select("seq", "model", F.round("cost_usd", 9).alias("cost_usd"))


_RAW = "'{\"urgency\":\"' || case when k % 3 = 0 then 'asap' else 'now' end || '\",\"category\":' || case when k % 5 = 0 then '7' else '\"other\"' end || ',\"reply_needed\":' || case when k % 4 = 0 then '\"true\"' else 'true' end || case when k % 7 = 0 then '' else ',\"phishing\":false' end || '}'"


@query(CTES + "select seq, concat_ws(',', case when k % 7 = 0 then 'fields' end, case when k % 3 = 0 then 'urgency' end, case when k % 5 = 0 then 'category' end, case when k % 4 = 0 then 'reply_needed' end, case when k % 7 = 0 then 'phishing' end) as problems from log")
def validate_answer(spark, log, sf_dir):
    raw = log.withColumn("k", F.col("tokens_in") - 400).withColumn("raw", F.expr(_RAW))
    return raw.select("seq", F.array_join(v.answer_problems(F.col("raw")), ",").alias("problems"))


@query(CTES + "select seq, 'now' as urgency, 'billing' as category, k >= 50 as reply_needed, (k * 71) % 100 >= 50 as phishing, k / 100.0::double as conf_urgency, k / 100.0::double as noul_reply from log")
def parse_probabilities(spark, log, sf_dir):
    num = lambda x: F.format_string("%.2f", x / 100.0)
    k = F.col("tokens_in") - 400
    raw = F.concat(F.lit('{"model":"m","answers":{"urgency":{"choice":"now","confidence":'), num(k), F.lit('},"category":{"choice":"billing","confidence":0.5},"reply_needed":{"noul":'), num(k), F.lit('},"phishing":{"noul":'), num(k * 71 % 100), F.lit("}}}"))
    got = log.select("seq", raw.alias("raw")).select("seq", *v.parse_probabilities("raw"))
    return got.select("seq", "answer.*", F.col("confidence")["urgency"].alias("conf_urgency"), F.col("noul")["reply_needed"].alias("noul_reply"))


@query("select d.doc_id as id, d.lang from documents d where d.doc_id in (select doc_id from labels)")
def evaluation_set(spark, log, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "lang")
    return v.evaluation_set(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id")))


@query(CTES + f"select {_CANDIDATE}, field, count(*) as n, round(count_if(pred = actual) / count(*), 4) as accuracy from p group by all")
def field_accuracy(spark, log, sf_dir):
    return m.field_accuracy(pairs_of(log))


_CLASSES = (
    CTES
    + ", classes as ("
    + " union all ".join(f"select '{f.name}' as field, '{c}' as class" for f in FIELDS for c in f.classes)
    + f"""), cls as (select g.dataset, g.model, g.field, c.class, count_if(p.pred = c.class and p.actual = c.class) as tp, count_if(p.actual = c.class) as actual, count_if(p.pred = c.class) as predicted
  from (select distinct dataset, model, field from p) g join classes c using (field) left join p on p.dataset = g.dataset and p.model = g.model and p.field = g.field group by all),
rp as (select *, round(tp / nullif(actual, 0), 4) as recall, round(tp / nullif(predicted, 0), 4) as precision from cls)
"""
)


@query(_CLASSES + "select * from rp")
def class_recall_precision(spark, log, sf_dir):
    return m.class_recall_precision(pairs_of(log))


@query(_CLASSES + f"select {_CANDIDATE}, field, round(avg(case when coalesce(recall, 0) + coalesce(precision, 0) > 0 then 2 * recall * precision / (recall + precision) else 0 end), 4) as macro_f1 from rp where actual > 0 group by all")
def macro_f1(spark, log, sf_dir):
    return m.macro_f1(m.class_recall_precision(pairs_of(log)))


@query(CTES + f"select {_CANDIDATE}, field, actual, pred, count(*) as n from p group by all")
def confusion_matrix(spark, log, sf_dir):
    return m.confusion_matrix(pairs_of(log))


@query(CTES + f"select {_CANDIDATE}, count(*) as n, round(count_if(correct) / count(*), 4) as all_correct from flags group by all")
def all_fields_correct(spark, log, sf_dir):
    return m.all_fields_correct(flags_of(log))


_SAME = "a.urgency = b.urgency", "a.category = b.category", "a.reply_needed = b.reply_needed", "a.phishing = b.phishing"
_CONSISTENCY = CTES + ", both_runs as (select a.dataset, a.model, " + ", ".join(f"{s} as {f}" for s, f in zip(_SAME, _F, strict=True)) + " from last a join last b on a.dataset = b.dataset and a.model = b.model and a.id = b.id and a.run = 1 and b.run = 2), cons as (" + " union all ".join(f"select dataset, model, '{n}' as field, round(count_if({c}) / count(*), 4) as consistency from both_runs group by all" for n, c in [*((f, f) for f in _F), ("all", " and ".join(_F))]) + ")"


@query(_CONSISTENCY + " select * from cons")
def run_consistency(spark, log, sf_dir):
    return m.run_consistency(fx.answers(log))


@query(CTES + f"select {_CANDIDATE}, round(quantile_cont(latency_ms, 0.5), 1) as p50, round(quantile_cont(latency_ms, 0.95), 1) as p95, round(avg(latency_ms), 1) as mean from cand where not failed group by all")
def latency_stats(spark, log, sf_dir):
    return m.latency_stats(fx.candidates(log))


@query(CTES + f"select {_CANDIDATE}, round(avg(cost_usd) * 1000, 4) as cost_per_1000 from cand group by all")
def cost_per_1000(spark, log, sf_dir):
    return m.cost_per_1000(fx.candidates(log))


@query(CTES + f"select {_CANDIDATE}, round(avg(tokens_in), 1) as tokens_in, round(avg(tokens_out), 1) as tokens_out from cand where not failed group by all")
def token_means(spark, log, sf_dir):
    return m.token_means(fx.candidates(log))


@query(CTES + f"select {_CANDIDATE}, split_part(error, ':', 1) as kind, count(*) as n, any_value(calls) as calls, any_value(invalid) as invalid from cand join (select dataset, model, count(*) as calls, count_if(failed) as invalid from cand group by all) using (dataset, model) where failed group by all")
def call_errors(spark, log, sf_dir):
    return v.error_kinds(fx.candidates(log), ["dataset", "model"]).join(m.call_errors(fx.candidates(log)), ["dataset", "model"])


@query(CTES + "select field, round(max(n) / sum(n), 4) as baseline from (select field, actual, count(*) as n from truth where actual is not null group by all) group by field")
def majority_baseline(spark, log, sf_dir):
    return m.majority_baseline(fx.truth(log))


@query(CTES + "select field, coalesce(actual, 'null') as class, count(*) as n from truth group by all")
def class_distribution(spark, log, sf_dir):
    return m.class_distribution(fx.truth(log))


_CERTAIN = "least(k / 100.0, ((k * 37) % 100) / 100.0, abs(((k * 53) % 100) / 100.0 - 0.5) * 2, abs(((k * 71) % 100) / 100.0 - 0.5) * 2)::double"


@query(CTES + f"select seq, round({_CERTAIN}, 6) as certainty from log")
def certainty(spark, log, sf_dir):
    return log.select("seq", F.round(m.certainty("confidence", "noul"), 6).alias("certainty"))


def sweep_of(log: DataFrame) -> DataFrame:
    return m.hybrid_sweep(m.first_runs(log, "primary"), m.first_runs(log, "fallback"), fx.truth(log))


def _first(model: str) -> str:
    return f"(select dataset, id, {', '.join(f'arg_max({f}, seq) as {f}' for f in _F)}, arg_max(cost_usd, seq) as cost, arg_max(latency_ms, seq) as latency, arg_max(round({_CERTAIN}, 6), seq) as certainty from cand where model = '{model}' and run = 1 and not failed group by all)"


_TRUTH_WIDE = "(select id, " + ", ".join(f"max(actual) filter (field = '{f}') as {f}" for f in _F) + " from truth group by id having bool_and(actual is not null))"
_HIT = {f.name: f"(case when up then b.{f.name} else a.{f.name} end = " + (f"trim(t.{f.name}, '\"'))" if f.kind == "string" else f"(t.{f.name} = 'true'))") for f in FIELDS}
_SWEEP = (
    CTES
    + f""", sweep as (select dataset, threshold, count(*) as n, round(count_if(up) / count(*), 4) as escalated, {", ".join(f"round(count_if({h}) / count(*), 4) as acc_{f}" for f, h in _HIT.items())}, round(count_if({" and ".join(_HIT.values())}) / count(*), 4) as acc_all,
  round(sum(a.cost + case when up then b.cost else 0 end) / count(*) * 1000, 4) as cost_per_1000, round(sum(a.latency + case when up then b.latency else 0 end) / count(*), 1) as latency_mean
  from (select a.*, x.threshold, a.certainty < x.threshold as up from {_first("primary")} a cross join (select unnest([{", ".join(f"{t}::double" for t in m.THRESHOLDS)}]) as threshold) x) a join {_first("fallback")} b using (dataset, id) join {_TRUTH_WIDE} t using (id) group by all)
"""
)


@query(_SWEEP + "select * from sweep")
def hybrid_sweep(spark, log, sf_dir):
    return sweep_of(log)


@query(_SWEEP + "select dataset, 'best' as point, arg_max(threshold, acc_all * 1000 - threshold / 1000) as threshold, max(acc_all) as acc_all, arg_max(escalated, acc_all * 1000 - threshold / 1000) as escalated from sweep group by dataset union all select dataset, 'named', threshold, acc_all, escalated from sweep where threshold = 0.7")
def hybrid_best(spark, log, sf_dir):
    return m.hybrid_best(sweep_of(log), 0.7)


_EMAILS = "select id, case user_id % 3 when 0 then 'gen_a' when 1 then 'gen_b' else 'gen_c' end as generator from log where seq % 8 = 0"


@query(CTES + f"select {_CANDIDATE}, generator, count(*) as n, round(count_if(correct) / count(*), 4) as all_correct, case generator when 'gen_a' then 'family_1' when 'gen_b' then 'family_2' else 'family_3' end as family from flags join ({_EMAILS}) using (id) group by all")
def generator_bias(spark, log, sf_dir):
    return m.generator_bias(flags_of(log), fx.emails(log).select("id", "generator"), fx.FAMILIES)


@query(CTES + f", intents as (select {fx.INTENT} from log where seq % 8 = 0), intended as ({fx._long('intents', 'id', 'intended')}) select field, round(count_if(intended = actual) / count(*), 4) as agreement from intended join truth using (id, field) where actual is not null group by field")
def intent_agreement(spark, log, sf_dir):
    return m.intent_agreement(fx.emails(log).select("id", "intent"), fx.truth(log))


_WILSON = "round(((k / n::double) + 3.8416 / (2 * n)) / (1 + 3.8416 / n) {s} 1.96 * sqrt((k / n::double) * (1 - k / n::double) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n), 4)"


@query(CTES + f"select field, class, k, n, {_WILSON.format(s='-')} as low, {_WILSON.format(s='+')} as high from (select field, class, k, cast(sum(k) over (partition by field) as bigint) as n from (select field, actual as class, count(*) as k from truth where actual is not null group by field, actual))")
def wilson_interval(spark, log, sf_dir):
    got = m.class_distribution(fx.truth(log)).where("class <> 'null'").withColumnRenamed("n", "k")
    got = got.join(got.groupBy("field").agg(F.sum("k").alias("n")), "field")
    low, high = m.wilson_interval(F.col("k"), F.col("n"))
    return got.select("field", "class", "k", "n", low.alias("low"), high.alias("high"))


@query(CTES + f"select *, round(k / n, 4) as share, {_WILSON.format(s='-')} as low, {_WILSON.format(s='+')} as high from (select dataset, model, count_if(correct) as k, count(*) as n from flags where run = 1 group by all)")
def significance_run1(spark, log, sf_dir):
    return m.significance_run1(flags_of(log))


@query(CTES + "select a.dataset, a.model as model_a, b.model as model_b, count_if(a.correct and not b.correct) as only_a, count_if(b.correct and not a.correct) as only_b from flags a join flags b on a.dataset = b.dataset and a.id = b.id and a.run = 1 and b.run = 1 and a.model < b.model group by all")
def mcnemar_counts(spark, log, sf_dir):
    return m.mcnemar_pairs(flags_of(log)).drop("p")


@query(
    CTES
    + """, c as (select a.dataset, a.model as model_a, b.model as model_b, count_if(a.correct and not b.correct) as only_a, count_if(b.correct and not a.correct) as only_b from flags a join flags b on a.dataset = b.dataset and a.id = b.id and a.run = 1 and b.run = 1 and a.model < b.model group by all)
select *, case when only_a = only_b then 1.0 else round(least(1.0, 2 * list_sum(list_transform(range(0, least(only_a, only_b)::bigint + 1), lambda i: exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))))), 4) end::double as p from c"""
)
def mcnemar_pairs(spark, log, sf_dir):
    return m.mcnemar_pairs(flags_of(log))


@query(CTES + f", q as (select dataset, model, quantile_cont(latency_ms, 0.25) as a, quantile_cont(latency_ms, 0.5) as b, quantile_cont(latency_ms, 0.75) as c from cand where not failed group by all) select {_CANDIDATE}, round(a, 4) as q1, round(b, 4) as median, round(c, 4) as q3, min(latency_ms) as low, max(latency_ms) as high from cand join q using (dataset, model) where not failed and latency_ms between a - 1.5 * (c - a) and c + 1.5 * (c - a) group by dataset, model, a, b, c")
def latency_box(spark, log, sf_dir):
    return m.latency_box(fx.candidates(log))


@query(
    _CONSISTENCY
    + f"""select c.dataset, c.model, c.calls, c.invalid, {", ".join(f"x.acc_{f}" for f in _F)}, x.recall_now, x.recall_phishing, a.all_correct, s.consistency, l.p50, l.p95, c.cost_per_1000
from (select dataset, model, count(*) as calls, count_if(failed) as invalid, round(avg(cost_usd) * 1000, 4) as cost_per_1000 from cand group by all) c
join (select dataset, model, {", ".join(f"round(count_if(field = '{f}' and pred = actual) / count_if(field = '{f}'), 4) as acc_{f}" for f in _F)},
  round(count_if(field = 'urgency' and actual = '"now"' and pred = actual) / nullif(count_if(field = 'urgency' and actual = '"now"'), 0), 4) as recall_now,
  round(count_if(field = 'phishing' and actual = 'true' and pred = actual) / nullif(count_if(field = 'phishing' and actual = 'true'), 0), 4) as recall_phishing from p group by all) x using (dataset, model)
join (select dataset, model, round(count_if(correct) / count(*), 4) as all_correct from flags group by all) a using (dataset, model)
join (select * from cons where field = 'all') s using (dataset, model)
join (select dataset, model, round(quantile_cont(latency_ms, 0.5), 1) as p50, round(quantile_cont(latency_ms, 0.95), 1) as p95 from cand where not failed group by all) l using (dataset, model)"""
)
def scorecard(spark, log, sf_dir):
    p = pairs_of(log)
    return m.scorecard(p, m.message_flags(p), fx.answers(log), fx.candidates(log))


@query(
    CTES
    + """, g as (select dataset, model, avg(latency_ms) filter (not failed) as latency, avg(tokens_in) filter (not failed) as ti, avg(tokens_out) filter (not failed) as tout, round(avg(cost_usd) * 1000, 4) as cost from cand group by all)
select g.dataset, g.model, round(b.latency / g.latency, 4) as speed_ratio, round(g.cost / b.cost, 4) as cost_ratio, round(100 * (1 - g.cost / b.cost), 2) as saving_pct, round((g.ti * 0.25 + g.tout * 2.0) / 1000, 4) as at_base_price from g join g b on b.dataset = g.dataset and b.model = 'fallback'"""
)
def relative_cost_speed(spark, log, sf_dir):
    return m.relative_cost_speed(fx.candidates(log), "fallback", prices(spark))
