"""What logged answers are worth against labels. Everything runs in long form, one row for each answer and field.

``pairs``: ``(dataset, model, id, run, field, pred, actual)`` with labels as text, open ones left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions.labels import FIELDS, Field, long_form, rate
from tallymark.functions.quantiles import group_quantiles
from tallymark.functions.storage import materialized

GROUP = ["dataset", "model"]
THRESHOLDS = (0.0, 0.3, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.01)


def truth_long(truth: DataFrame, fields: tuple[Field, ...] = FIELDS) -> DataFrame:
    """``(id, field, actual, complete)``, open fields included; complete: the id has none."""
    whole = F.lit(True)
    for f in fields:
        whole &= F.col(f"truth.{f.name}").isNotNull()
    return truth.select("id", whole.alias("complete"), long_form("truth", fields, "actual").alias("x")).select("id", "complete", "x.*")


def pairs(answers: DataFrame, truth: DataFrame, fields: tuple[Field, ...] = FIELDS) -> DataFrame:
    a = answers.select(*GROUP, "id", "run", long_form("answer", fields, "pred").alias("x")).select(*GROUP, "id", "run", "x.*")
    return a.join(truth_long(truth, fields).where("actual is not null"), ["id", "field"])


def field_accuracy(p: DataFrame) -> DataFrame:
    return p.groupBy(*GROUP, "field").agg(F.count("*").alias("n"), rate(F.count_if(F.col("pred") == F.col("actual")), F.count("*")).alias("accuracy"))


def class_recall_precision(p: DataFrame, fields: tuple[Field, ...] = FIELDS) -> DataFrame:
    """By class: hits, how often it is true, how often predicted, recall and precision; every listed class is reported.

    The class list has a few rows a field and is broadcast; both roles of a class are counted in one pass.
    """
    roles = F.explode(F.array(F.struct(F.col("actual").alias("class"), F.lit(1).alias("actual"), F.lit(0).alias("predicted"), (F.col("pred") == F.col("actual")).cast("int").alias("tp")), F.struct(F.col("pred").alias("class"), F.lit(0).alias("actual"), F.lit(1).alias("predicted"), F.lit(0).alias("tp"))))
    counts = p.select(*GROUP, "field", roles.alias("x")).select(*GROUP, "field", "x.*").groupBy(*GROUP, "field", "class").agg(*(F.sum(c).alias(c) for c in ("tp", "actual", "predicted")))
    return _every_class(p, counts, fields)


def _every_class(p: DataFrame, counts: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
    """Counts with zeros for listed classes that don't occur, and the rates."""
    classes = p.sparkSession.createDataFrame([(f.name, c) for f in fields for c in f.classes], "field string, class string")
    groups = p.select(*GROUP, "field").distinct().join(F.broadcast(classes), "field")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "actual", "predicted")]
    all_ = groups.join(counts, [*GROUP, "field", "class"], "left").select(*GROUP, "field", "class", *zero)
    return all_.select("*", rate(F.col("tp"), F.col("actual")).alias("recall"), rate(F.col("tp"), F.col("predicted")).alias("precision"))


def macro_f1(classes: DataFrame) -> DataFrame:
    """Mean F1 of the classes that occur in truth, from the rounded recall and precision."""
    r, q = F.coalesce("recall", F.lit(0.0)), F.coalesce("precision", F.lit(0.0))
    f1 = F.when(r + q > 0, 2 * r * q / (r + q)).otherwise(0.0)
    return classes.where("actual > 0").groupBy(*GROUP, "field").agg(F.round(F.avg(f1), 4).alias("macro_f1"))


def confusion_matrix(p: DataFrame) -> DataFrame:
    return p.groupBy(*GROUP, "field", "actual", "pred").agg(F.count("*").alias("n"))


def report_counts(p: DataFrame) -> DataFrame:
    """What the report's tables are made of, from one scan of the pairs: counts by field, label and answer (``part`` 1) and a row for each answered message (``part`` 2).

    Two grouping sets in one partial aggregation. The first is a few rows a model; the second has ``correct`` and ``complete`` of each message and run.
    """
    sets = [[*GROUP, "field", "actual", "pred"], [*GROUP, "id", "run"]]
    right = F.coalesce(F.col("pred") == F.col("actual"), F.lit(False)).alias("right")
    rows = p.select(*GROUP, "field", "actual", "pred", "id", "run", "complete", right)
    part = F.when(F.grouping("field") == 0, 1).otherwise(2).alias("part")
    return rows.groupingSets(sets, *GROUP, "field", "actual", "pred", "id", "run").agg(part, F.count("*").alias("n"), F.bool_and("right").alias("correct"), F.bool_and("complete").alias("complete"))


def counted_confusion(counts: DataFrame) -> DataFrame:
    return counts.where("part = 1").select(*GROUP, "field", "actual", "pred", "n")


def counted_flags(counts: DataFrame) -> DataFrame:
    return counts.where("part = 2 and complete").select(*GROUP, "id", "run", "correct")


def counted_accuracy(confusion: DataFrame) -> DataFrame:
    n = F.sum("n")
    return confusion.groupBy(*GROUP, "field").agg(n.alias("n"), rate(F.sum(F.when(F.col("pred") == F.col("actual"), F.col("n")).otherwise(0)), n).alias("accuracy"))


def counted_classes(confusion: DataFrame, fields: tuple[Field, ...] = FIELDS) -> DataFrame:
    """class_recall_precision() from the confusion matrix: each cell counts for its label's class and its answer's class."""
    cells = confusion.select(*GROUP, "field", F.explode(F.array(F.struct(F.col("actual").alias("class"), F.when(F.col("pred") == F.col("actual"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("predicted")), F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("predicted")))).alias("x"))
    sums = cells.select(*GROUP, "field", "x.*").groupBy(*GROUP, "field", "class").agg(*(F.sum(c).alias(c) for c in ("tp", "actual", "predicted")))
    return _every_class(confusion, sums, fields)


def message_flags(p: DataFrame) -> DataFrame:
    """For answers on complete messages: are all fields right?"""
    return p.where("complete").groupBy(*GROUP, "id", "run").agg(F.bool_and(F.coalesce(F.col("pred") == F.col("actual"), F.lit(False))).alias("correct"))


def all_fields_correct(flags: DataFrame) -> DataFrame:
    return flags.groupBy(*GROUP).agg(F.count("*").alias("n"), rate(F.count_if("correct"), F.count("*")).alias("all_correct"))


def run_consistency(answers: DataFrame, fields: tuple[Field, ...] = FIELDS) -> DataFrame:
    """Share of ids with equal answers in a model's first two runs, by field and for all; nothing for one run."""
    runs = answers.groupBy(*GROUP).agg(F.slice(F.array_sort(F.collect_set("run")), 1, 2).alias("first")).where("size(first) = 2")
    both = answers.join(F.broadcast(runs), GROUP).where(F.array_contains("first", F.col("run")))
    each = both.groupBy(*GROUP, "id").agg(F.max_by("answer", "run").alias("a"), F.min_by("answer", "run").alias("b"), F.count("*").alias("n")).where("n = 2")
    same = {f.name: F.col(f"a.{f.name}").eqNullSafe(F.col(f"b.{f.name}")) for f in fields}
    every = F.lit(True)
    for s in same.values():
        every &= s
    rows = each.select(*GROUP, F.explode(F.array(*(F.struct(F.lit(k).alias("field"), v.alias("same")) for k, v in [*same.items(), ("all", every)]))).alias("x"))
    return rows.groupBy(*GROUP, "x.field").agg(rate(F.count_if("x.same"), F.count("*")).alias("consistency"))


def latency_stats(log: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Median, 95th percentile (interpolated; approximate with ``accuracy``) and mean over valid answers."""
    valid = log.where("answer is not null")
    got = valid.groupBy(*GROUP).agg(F.avg("latency_ms").alias("mean")).join(group_quantiles(valid, GROUP, "latency_ms", [0.5, 0.95], accuracy), GROUP, "left")
    return got.select(*GROUP, F.round(F.col("q")[0], 1).alias("p50"), F.round(F.col("q")[1], 1).alias("p95"), F.round("mean", 1).alias("mean"))


def cost_per_1000(log: DataFrame) -> DataFrame:
    """Over all calls, failed ones too."""
    return log.groupBy(*GROUP).agg(F.round(F.avg("cost_usd") * 1000, 4).alias("cost_per_1000"))


def token_means(log: DataFrame) -> DataFrame:
    return log.where("answer is not null").groupBy(*GROUP).agg(F.round(F.avg("tokens_in"), 1).alias("tokens_in"), F.round(F.avg(F.coalesce("tokens_out", F.lit(0))), 1).alias("tokens_out"))


def call_errors(log: DataFrame) -> DataFrame:
    return log.groupBy(*GROUP).agg(F.count("*").alias("calls"), F.count_if(F.col("answer").isNull()).alias("invalid"))


def majority_baseline(truth: DataFrame, fields: tuple[Field, ...] = FIELDS) -> DataFrame:
    """Accuracy of always guessing the most frequent class."""
    n = truth_long(truth, fields).where("actual is not null").groupBy("field", "actual").agg(F.count("*").alias("n"))
    return n.groupBy("field").agg(rate(F.max("n"), F.sum("n")).alias("baseline"))


def class_distribution(truth: DataFrame, fields: tuple[Field, ...] = FIELDS) -> DataFrame:
    return truth_long(truth, fields).groupBy("field", F.coalesce("actual", F.lit("null")).alias("class")).agg(F.count("*").alias("n"))


def certainty(confidence: str | Column, noul: str | Column) -> Column:
    """Least certainty over all fields: a choice's confidence, or twice a probability's distance from a half; 0 for none."""
    known = F.filter(F.coalesce(F.map_values(confidence), F.array().cast("array<double>")), lambda x: x.isNotNull())
    far = F.transform(F.coalesce(F.map_values(noul), F.array().cast("array<double>")), lambda p: F.abs(p - 0.5) * 2)
    return F.coalesce(F.array_min(F.concat(known, far)), F.lit(0.0))


def first_runs(log: DataFrame, model: str) -> DataFrame:
    """Of each id the model's last valid call of run 1, with its certainty."""
    rows = log.where((F.col("model") == model) & (F.col("run") == 1) & F.col("answer").isNotNull()).withColumn("certainty", F.round(certainty("confidence", "noul"), 6))
    return rows.groupBy("dataset", "id").agg(*(F.max_by(c, "seq").alias(c) for c in ("answer", "cost_usd", "latency_ms", "certainty")))


def hybrid_sweep(primary: DataFrame, fallback: DataFrame, truth: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, fields: tuple[Field, ...] = FIELDS) -> DataFrame:
    """What routing gives: answers of the primary model, or the fallback's where certainty is below a threshold.

    Both inputs: ``(dataset, id, answer, cost_usd, latency_ms)`` of run 1, one row an id, the primary's with
    ``certainty``. Escalated messages cost the sum of both and take as long as both. Rows are summed once by bucket of certainty (how many
    thresholds lie at or below it), both ways; a threshold then takes the fallback's sums of the buckets below it and the primary's of the
    others, over a handful of rows, so what is shuffled doesn't depend on the number of thresholds.
    """
    whole = F.lit(True)
    for f in fields:
        whole &= F.col(f"truth.{f.name}").isNotNull()
    ts = sorted(thresholds)
    bucket = sum((F.when(F.col("certainty") >= t, 1).otherwise(0) for t in ts), F.lit(0)).alias("bucket")
    p = primary.select("dataset", "id", bucket, F.col("answer").alias("a"), F.col("cost_usd").alias("ca"), F.col("latency_ms").alias("la"))
    q = fallback.select("dataset", "id", F.col("answer").alias("b"), F.col("cost_usd").alias("cb"), F.col("latency_ms").alias("lb"))
    rows = p.join(q, ["dataset", "id"]).join(truth.where(whole).select("id", "truth"), "id")

    def right(side: str) -> dict[str, Column]:
        each = {f.name: F.coalesce(F.col(f"{side}.{f.name}") == F.col(f"truth.{f.name}"), F.lit(False)) for f in fields}
        every = F.lit(True)
        for r in each.values():
            every &= r
        return {**each, "all": every}

    counts = [F.count_if(r).alias(f"{side}_{k}") for side in "ab" for k, r in right(side).items()]
    sums = rows.groupBy("dataset", "bucket").agg(F.count("*").alias("n"), *counts, *(F.sum(c).alias(c) for c in ("ca", "cb", "la", "lb")))
    at = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(ts))))
    up = F.col("bucket") <= F.col("x.i")
    n = F.sum("n")
    either = lambda k: F.sum(F.when(up, F.col(f"b_{k}")).otherwise(F.col(f"a_{k}")))
    both = lambda k: F.sum(F.col(f"{k}a") + F.when(up, F.col(f"{k}b")).otherwise(0.0))
    return sums.select("*", at.alias("x")).groupBy("dataset", F.col("x.threshold").alias("threshold")).agg(
        n.alias("n"), rate(F.sum(F.when(up, F.col("n")).otherwise(0)), n).alias("escalated"), *(rate(either(f.name), n).alias(f"acc_{f.name}") for f in fields), rate(either("all"), n).alias("acc_all"),
        F.round(both("c") / n * 1000, 4).alias("cost_per_1000"), F.round(both("l") / n, 1).alias("latency_mean"),
    )


def hybrid_best(sweep: DataFrame, named: float) -> DataFrame:
    """The best point of each dataset (the least threshold in ties) and the point at a named threshold."""
    best = sweep.groupBy("dataset").agg(F.max_by(F.struct("threshold", "acc_all", "escalated"), F.struct("acc_all", -F.col("threshold"))).alias("x")).select("dataset", F.lit("best").alias("point"), "x.*")
    return best.unionByName(sweep.where(F.col("threshold") == named).select("dataset", F.lit("named").alias("point"), "threshold", "acc_all", "escalated"))


def generator_bias(flags: DataFrame, generators: DataFrame, families: dict[str, str]) -> DataFrame:
    """Share of all-correct answers by model and by the generator of the message, with its family."""
    family = F.create_map(*(F.lit(x) for kv in families.items() for x in kv))[F.col("generator")] if families else F.lit(None).cast("string")
    return flags.join(generators, "id").groupBy(*GROUP, "generator").agg(F.count("*").alias("n"), rate(F.count_if("correct"), F.count("*")).alias("all_correct")).withColumn("family", family)


def intent_agreement(intents: DataFrame, truth: DataFrame, fields: tuple[Field, ...] = FIELDS) -> DataFrame:
    """By field: share of known labels that equal the intended one."""
    i = intents.select("id", long_form("intent", fields, "intended").alias("x")).select("id", "x.*")
    both = i.join(truth_long(truth, fields).where("actual is not null"), ["id", "field"])
    return both.groupBy("field").agg(rate(F.count_if(F.col("intended").eqNullSafe(F.col("actual"))), F.count("*")).alias("agreement"))


def wilson_interval(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the 95 % interval for a share, four digits; null for nothing."""
    n = F.when(n > 0, n.cast("double"))
    p, zz = k / n, z * z
    centre = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.round(centre - half, 4), F.round(centre + half, 4)


def significance_run1(flags: DataFrame) -> DataFrame:
    got = flags.where("run = 1").groupBy(*GROUP).agg(F.count_if("correct").alias("k"), F.count("*").alias("n"))
    low, high = wilson_interval(F.col("k"), F.col("n"))
    return got.select("*", rate(F.col("k"), F.col("n")).alias("share"), low.alias("low"), high.alias("high"))


@F.pandas_udf(T.DoubleType())
def mcnemar_p(only_a: pd.Series, only_b: pd.Series) -> pd.Series:
    """Exact two-sided binomial p-value, four digits, for counts of any size.

    Terms fall off from the largest, at min(a, b), by factors of k / (n - k + 1); the sum ends where they are nothing, and memory
    doesn't grow with the counts.
    """
    from math import exp, lgamma, log, log1p, pi

    def one(a: int, b: int) -> float:
        n, k = a + b, min(a, b)
        if a == b:
            return 1.0
        if k < 1000:
            top = lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * log(2)
        else:  # by Stirling's series, which loses nothing to differences of huge logarithms
            x = (n - 2 * k) / n
            top = -(log(2 * pi * k * ((n - k) / n)) + n * ((1 - x) * log1p(-x) + (1 + x) * log1p(x))) / 2 + (1 / n - 1 / k - 1 / (n - k)) / 12
        total, log_term, i = 1.0, 0.0, 0
        while i < k and log_term > -40:  # in stretches; a term of e**-40 of the largest is below the sum's last digit
            back = np.arange(i, min(k, i + 100_000))
            steps = log_term + np.cumsum(np.log(k - back) - np.log(n - k + back + 1))
            total, log_term, i = total + float(np.exp(steps).sum()), float(steps[-1]), i + len(back)
        return round(min(1.0, 2 * exp(top) * total), 4)

    return pd.Series([one(int(a), int(b)) for a, b in zip(only_a, only_b, strict=True)])


def mcnemar_pairs(flags: DataFrame) -> DataFrame:
    """By pair of models: messages of run 1 that only one of them got right, and the exact p-value.

    A message's flags are gathered once (a handful of models each) and paired in place, without joins of models with models.
    """
    each = flags.where("run = 1").groupBy("dataset", "id").agg(F.array_sort(F.collect_list(F.struct("model", "correct"))).alias("m"))
    paired = each.select("dataset", F.explode("m").alias("a"), "m").select("dataset", "a", F.explode(F.filter("m", lambda x: x.model > F.col("a.model"))).alias("b"))
    counts = paired.groupBy("dataset", F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b")).agg(F.count_if(F.expr("a.correct and not b.correct")).alias("only_a"), F.count_if(F.expr("b.correct and not a.correct")).alias("only_b"))
    return counts.withColumn("p", mcnemar_p("only_a", "only_b"))


def latency_box(log: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Quartiles (approximate with ``accuracy``) and whiskers: the furthest valid latencies within 1.5 times the quartiles' distance."""
    valid = log.where("answer is not null")
    q = materialized(group_quantiles(valid, GROUP, "latency_ms", [0.25, 0.5, 0.75], accuracy))
    reach = (F.col("q")[2] - F.col("q")[0]) * 1.5
    both = valid.join(q, GROUP).where(F.col("latency_ms").between(F.col("q")[0] - reach, F.col("q")[2] + reach))
    got = both.groupBy(*GROUP).agg(F.first("q").alias("q"), F.min("latency_ms").alias("low"), F.max("latency_ms").alias("high"))
    return got.select(*GROUP, *(F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("q1", "median", "q3"))), "low", "high")


def scorecard(p: DataFrame, flags: DataFrame, answers: DataFrame, log: DataFrame, fields: tuple[Field, ...] = FIELDS, accuracy: int | None = None) -> DataFrame:
    """One row for each dataset and model; all parts are small once aggregated. ``accuracy`` makes percentiles approximate."""
    confusion = confusion_matrix(p)
    return scorecard_of(counted_accuracy(confusion), counted_classes(confusion, fields), flags, answers, log, fields, accuracy)


def scorecard_of(accuracies: DataFrame, classes: DataFrame, flags: DataFrame, answers: DataFrame, log: DataFrame, fields: tuple[Field, ...] = FIELDS, accuracy: int | None = None) -> DataFrame:
    """The scorecard from tables that are there already."""
    acc = accuracies.groupBy(*GROUP).pivot("field", [f.name for f in fields]).agg(F.first("accuracy"))
    acc = acc.select(*GROUP, *(F.col(f.name).alias(f"acc_{f.name}") for f in fields))
    of = lambda f, c: F.max(F.when((F.col("field") == f) & (F.col("class") == c), F.col("recall")))
    recall = classes.groupBy(*GROUP).agg(of("urgency", '"now"').alias("recall_now"), of("phishing", "true").alias("recall_phishing"))
    same = run_consistency(answers, fields).where("field = 'all'").select(*GROUP, "consistency")
    out = call_errors(log)
    for part in (acc, recall, all_fields_correct(flags).select(*GROUP, "all_correct"), same, latency_stats(log, accuracy).select(*GROUP, "p50", "p95"), cost_per_1000(log)):
        out = out.join(part, GROUP, "left")
    return out


def relative_cost_speed(log: DataFrame, base: str, prices: DataFrame) -> DataFrame:
    """Each model against a base one: ratio of mean latencies, ratio and saving of cost, cost of its tokens at the base's price."""
    means = log.where("answer is not null").groupBy(*GROUP).agg(F.avg("latency_ms").alias("latency"), F.avg("tokens_in").alias("ti"), F.avg("tokens_out").alias("to")).join(cost_per_1000(log), GROUP)
    b = means.where(F.col("model") == base).select("dataset", F.col("latency").alias("bl"), F.col("cost_per_1000").alias("bc")).join(F.broadcast(prices.where(F.col("model") == base).select("usd_in", "usd_out")))
    return means.join(F.broadcast(b), "dataset").select(
        *GROUP, F.round(F.try_divide("bl", "latency"), 4).alias("speed_ratio"), F.round(F.try_divide("cost_per_1000", "bc"), 4).alias("cost_ratio"), F.round(100 * (1 - F.try_divide("cost_per_1000", "bc")), 2).alias("saving_pct"),
        F.round((F.col("ti") * F.col("usd_in") + F.col("to") * F.col("usd_out")) / 1000, 4).alias("at_base_price"),
    )
