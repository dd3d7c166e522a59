"""From logged answers of several judges to labels by majority, with open cases and manual decisions.

Logs have ``(seq, model, id, run, answer struct, error, latency_ms, tokens_in, tokens_out, cost_usd)``;
``answer`` is null for a failed call, and ``seq`` is the order of writing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.labels import FIELDS, Field, long_form, rate, unlabel
from tallymark.functions.quantiles import group_quantiles
from tallymark.functions.storage import numbered

#: Records that a task may hold to draw the first of them.
HELD = 100


def draw_sample(records: DataFrame, n: int, seed: int, texts: tuple[str, ...] = ("text", "subject")) -> DataFrame:
    """``n`` records that have a text, always the same for a seed, sorted by id; all if there are no more.

    The smallest hashes are drawn: by a top-n where a task can hold that many, else up to a bound found from counts, and
    ``records`` are read twice or more.
    """
    some = F.lit(False)
    for t in texts:
        some |= F.coalesce(F.length(t), F.lit(0)) > 0
    hashed = records.where(some).withColumn("_draw", F.xxhash64(F.col("id").cast("string"), F.lit(seed)))
    if n <= HELD:
        drawn = hashed.orderBy("_draw", "id").limit(n)
    else:  # a draw of all needs no look at texts
        drawn = hashed if records.count() <= n else _smallest(hashed, n)
    return drawn.drop("_draw").orderBy(F.col("id").cast("string"))


def _smallest(hashed: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows with the smallest ``_draw``, all if there are no more; no task holds or receives the others.

    Rows are counted by the hash's first 16 bits, then by the next ones where the bound lies, until it has ``n`` rows below it, mostly
    at once or in the second round. Rows of one hash, thus of one id, are told apart by their JSON and dealt by ranges.
    """
    rows, left = hashed, n
    for shift in (48, 32, 16, 0):
        bits = F.shiftright("_draw", shift)
        for prefix, count in sorted(map(tuple, rows.groupBy(bits).count().collect())):
            if count >= left:
                break
            left -= count
        else:
            return hashed
        if count == left:
            return hashed.where(bits <= prefix)
        rows = rows.where(bits == prefix)
    at = numbered(rows, [F.col("id"), F.sha2(F.to_json(F.struct("*")), 256), F.monotonically_increasing_id()], "_at")
    return hashed.where(F.col("_draw") < prefix).unionByName(at.where(F.col("_at") <= left).drop("_at"))


def pending_work(models: DataFrame, ids: DataFrame, log: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Pairs of model and id (and run) without a valid answer; failed ones come back.

    Model and run lists are a handful of rows by nature and are broadcast to the ids.
    """
    todo = ids.join(F.broadcast(models))
    keys = ["model", "id"]
    if runs is not None:
        todo, keys = todo.join(F.broadcast(runs)), [*keys, "run"]
    return todo.join(log.where("answer is not null").select(keys), keys, "left_anti").select(keys)


def warmup_calls(todo: DataFrame, n: int, warmup: str = "warmup") -> DataFrame:
    """``(model, id, turn)``: ``n`` warm-up calls for each model that still has work in ``todo(model, ...)``, none for the others."""
    return todo.select("model").distinct().select("model", F.lit(warmup).alias("id"), F.explode(F.sequence(F.lit(1), F.lit(n)) if n > 0 else F.array().cast("array<int>")).alias("turn"))


def without_warmup(calls: DataFrame, warmup: str = "warmup") -> DataFrame:
    """The calls that are logged: warm-up calls are paid for (``spent``), but count in no figure."""
    return calls.where(~F.col("id").eqNullSafe(F.lit(warmup)))


def spent(calls: DataFrame, *keys: str) -> DataFrame:
    """``cost_usd`` of all calls by ``keys`` (by model, if none are named), warm-up and failed ones included; what budgets are held against."""
    return calls.groupBy(*(keys or ("model",))).agg(F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("cost_usd"))


def budget_cutoff(calls: DataFrame, limit: float, per: list[str], spent: float = 0.0) -> DataFrame:
    """Calls that start: in order of ``seq``, those before which less than the limit was spent; the last may overshoot.

    Sums go by ranges of ``per`` and ``seq``, so a model with most of the calls is not one task.
    """
    summed = numbered(calls, [F.col("seq")], "spent_before", F.coalesce("cost_usd", F.lit(0.0)), tuple(per))
    return summed.withColumn("spent_before", F.col("spent_before") + spent).where(F.col("spent_before") < limit)


def latest_answers(log: DataFrame, keys: list[str]) -> DataFrame:
    """The last valid answer for each key; failures after it don't erase it. One partially aggregated pass, no sort."""
    return log.where("answer is not null").groupBy(*keys).agg(F.max_by("answer", "seq").alias("answer"))


def consensus(answers: DataFrame, ids: DataFrame, fields: tuple[Field, ...] = FIELDS, needed: int = 2) -> DataFrame:
    """Labels by majority: ``(id, truth struct, votes, agreement map, open array)`` for every id.

    ``answers(id, model, seq, answer)`` has one row for each judge. A field needs ``needed`` equal votes, else
    it is null and listed as open; ties go to the value that was voted for first.
    """
    votes = answers.select("id", "seq", long_form("answer", fields).alias("x")).select("id", "seq", "x.*").where("label is not null")
    counted = votes.groupBy("id", "field", "label").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    top = counted.groupBy("id", "field").agg(F.max(F.struct("n", (-F.col("first")).alias("early"), "label")).alias("top"))
    by_id = top.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", "top"))).alias("tops"))
    judges = answers.groupBy("id").agg(F.count("*").cast("int").alias("votes"))
    got = ids.select("id").distinct().join(by_id, "id", "left").join(judges, "id", "left")
    n = {f.name: F.coalesce(F.col("tops")[f.name]["n"], F.lit(0)).cast("int") for f in fields}
    chosen = [F.when(n[f.name] >= needed, unlabel(F.col("tops")[f.name]["label"], f)).alias(f.name) for f in fields]
    agreement = F.create_map(*(x for f in fields for x in (F.lit(f.name), n[f.name])))
    return got.select("id", F.struct(*chosen).alias("truth"), F.coalesce("votes", F.lit(0)).alias("votes"), agreement.alias("agreement"), open_fields(n, needed, fields).alias("open"))


def open_fields(n: dict[str, Column], needed: int, fields: tuple[Field, ...]) -> Column:
    return F.array_compact(F.array(*(F.when(n[f.name] < needed, F.lit(f.name)) for f in fields)))


def apply_decisions(truth: DataFrame, decisions: DataFrame, fields: tuple[Field, ...] = FIELDS) -> DataFrame:
    """Manual ``decisions(id, field, value text)`` replace labels; open fields shrink, ``manual`` lists the decided ones.

    Raises ValueError for an unknown id or field.
    """
    unknown = decisions.join(truth.select("id"), "id", "left_anti").unionByName(decisions.where(~F.col("field").isin(*(f.name for f in fields)))).limit(1).collect()
    if unknown:
        raise ValueError(f"a decision for an unknown id or field: {unknown[0].asDict()}")
    given = decisions.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("given"))
    both = truth.join(given, "id", "left")
    new = [F.coalesce(F.col("given")[f.name].cast(f.kind), F.col(f"truth.{f.name}")).alias(f.name) for f in fields]
    manual = F.coalesce(F.array_sort(F.map_keys("given")), F.array().cast("array<string>"))
    return both.select("id", F.struct(*new).alias("truth"), "votes", "agreement", F.array_except("open", manual).alias("open"), manual.alias("manual"))


def judge_stats(log: DataFrame, accuracy: int | None = None) -> DataFrame:
    """By model: valid and failed calls, cost, median latency of valid calls (approximate with ``accuracy``); ``error_kinds`` has the failures' kinds."""
    ok = F.col("answer").isNotNull()
    counts = log.groupBy("model").agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"))
    median = group_quantiles(log.where(ok), ["model"], "latency_ms", [0.5], accuracy)
    return counts.join(median, "model", "left").select("model", "ok", "failed", "cost_usd", F.round(F.col("q")[0], 0).alias("latency_p50_ms"))


def error_kinds(log: DataFrame, keys: list[str]) -> DataFrame:
    """Failed calls by kind: the error's text up to its first colon."""
    return log.where("error is not null").groupBy(*keys, F.substring_index("error", ":", 1).alias("kind")).agg(F.count("*").alias("n"))


def vote_summary(truth: DataFrame, judges: int, fields: tuple[Field, ...] = FIELDS) -> DataFrame:
    """By field: ids on which all judges agree, and ids with a majority."""
    rows = truth.select("agreement", F.explode(F.array(*(F.struct(F.lit(f.name).alias("field"), F.col(f"truth.{f.name}").isNotNull().alias("known")) for f in fields))).alias("x"))
    agreed = F.element_at("agreement", F.col("x.field"))
    return rows.groupBy("x.field").agg(F.count("*").alias("emails"), F.count_if(agreed == judges).alias("unanimous"), F.count_if("x.known").alias("with_majority"), F.count_if(~F.col("x.known")).alias("open"))


def vote_totals(truth: DataFrame, log: DataFrame) -> DataFrame:
    """One row: messages, those with an open field, open fields over all messages, cost of all calls."""
    row = truth.agg(F.count("*").alias("emails"), F.count_if(F.size("open") > 0).alias("emails_open"), F.coalesce(F.sum(F.size("open")), F.lit(0)).cast("long").alias("fields_open"))
    return row.join(log.agg(F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 4).alias("cost_usd")))


def agreement_with_majority(answers: DataFrame, truth: DataFrame, fields: tuple[Field, ...] = FIELDS) -> DataFrame:
    """By judge and field: share of answers equal to the label, three digits."""
    a = answers.select("id", "model", long_form("answer", fields).alias("x")).select("id", "model", "x.*")
    t = truth.select("id", long_form("truth", fields, "actual").alias("x")).select("id", "x.*").where("actual is not null")
    return a.join(t, ["id", "field"]).groupBy("model", "field").agg(rate(F.count_if(F.col("label") == F.col("actual")), F.count("*"), 3).alias("agreement"))


def answer_problems(raw: Column, fields: tuple[Field, ...] = FIELDS) -> Column:
    """What is wrong with an answer in JSON text: field set, classes, types; an empty list if nothing is."""
    keys = F.array_sort(F.json_object_keys(raw))
    names = F.array(*map(F.lit, sorted(f.name for f in fields)))
    checks = [F.when(keys.isNull() | (keys != names), F.lit("fields"))]
    for f in fields:
        # A string can't be told from a boolean once extracted, so the variant's type is looked at.
        kind = F.schema_of_variant(F.try_parse_json(F.to_json(F.struct(F.try_variant_get(F.try_parse_json(raw), f"$.{f.name}", "variant").alias("v")))))
        got = F.get_json_object(raw, f"$.{f.name}")
        want = "OBJECT<v: STRING>" if f.kind == "string" else "OBJECT<v: BOOLEAN>"
        fine = (kind == want) & (got.isin(*(c.strip('"') for c in f.classes)) if f.kind == "string" else F.lit(True))
        checks.append(F.when(~F.coalesce(fine, F.lit(False)), F.lit(f.name)))
    return F.array_compact(F.array(*checks))


def call_cost(log: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds ``cost_usd`` from a price list ``(model, usd_in, usd_out)`` in dollars for a million tokens.

    A price list has a row for each model, so that Spark broadcasts it by its size.
    """
    cost = (F.col("tokens_in") * F.col("usd_in") + F.coalesce("tokens_out", F.lit(0)) * F.col("usd_out")) / 1e6
    return log.join(prices, "model", "left").withColumn("cost_usd", cost).drop("usd_in", "usd_out")


def parse_probabilities(raw: str, fields: tuple[Field, ...] = FIELDS, threshold: float = 0.5) -> list[Column]:
    """Columns ``answer``, ``confidence`` and ``noul`` from a model's nested response in JSON text.

    Choice fields are taken as they are, probabilities from the threshold on are true.
    """
    kinds = {"string": "choice:string,confidence:double,probabilities:map<string,double>", "boolean": "noul:double"}
    parsed = F.from_json(raw, f"model string, answers struct<{','.join(f'{f.name}:struct<{kinds[f.kind]}>' for f in fields)}>")["answers"]
    answer = F.struct(*((parsed[f.name]["choice"] if f.kind == "string" else parsed[f.name]["noul"] >= threshold).alias(f.name) for f in fields))
    maps = [F.create_map(*(x for f in fields if f.kind == k for x in (F.lit(f.name), parsed[f.name][v]))) for k, v in (("string", "confidence"), ("boolean", "noul"))]
    return [answer.alias("answer"), maps[0].alias("confidence"), maps[1].alias("noul")]


def evaluation_set(emails: DataFrame, truth: DataFrame) -> DataFrame:
    """Emails that have a truth row; raises ValueError if a truth row has no email."""
    if truth.join(emails, "id", "left_anti").limit(1).count():
        raise ValueError("labels without an email")
    return emails.join(truth, "id", "left_semi")
