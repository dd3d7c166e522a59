"""The evaluation report: all tables about candidates' answers, written in one go."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions.storage import materialized
from tallymark.jobs import fixtures as fx
from tallymark.operators import metrics as m
from tallymark.operators.votes import error_kinds
from tallymark.sources.files import write_report


def hybrids(calls: DataFrame, truth: DataFrame, primary: str, fallbacks: list[str], named: float) -> tuple[DataFrame, DataFrame]:
    """Sweep and best points of the primary model with each fallback."""
    first = materialized(m.first_runs(calls, primary))
    sweeps = [(f, m.hybrid_sweep(first, m.first_runs(calls, f), truth)) for f in fallbacks]
    sweep = materialized(reduce(DataFrame.unionByName, (s.select(F.lit(f).alias("fallback"), "*") for f, s in sweeps)))
    best = [m.hybrid_best(sweep.where(F.col("fallback") == f), named).select(F.lit(f).alias("fallback"), "*") for f in fallbacks]
    return sweep, reduce(DataFrame.unionByName, best)


def report_tables(log: DataFrame, truth: DataFrame, emails: DataFrame | None = None, families: dict[str, str] | None = None, primary: tuple[str, ...] = ("primary",), named: float = 0.7, accuracy: int | None = None) -> dict[str, DataFrame]:
    """Sections by name. The joined pairs are scanned once, into the counts that all sections about them are made of.

    The first of the ``primary`` models is swept with each model that isn't one of them. ``emails(id, generator, intent)``
    of the synthetic messages give bias and agreement with the intent. ``accuracy`` makes percentiles approximate.
    """
    answers = materialized(fx.answers(log))
    counts = materialized(m.report_counts(m.pairs(answers, truth)))
    confusion, flags = m.counted_confusion(counts), m.counted_flags(counts)
    calls = fx.candidates(log)
    fields, classes = m.counted_accuracy(confusion), m.counted_classes(confusion)
    tables = {
        "scorecard": m.scorecard_of(fields, classes, flags, answers, calls, accuracy=accuracy), "fields": fields, "classes": classes, "macro_f1": m.macro_f1(classes), "confusion": confusion, "consistency": m.run_consistency(answers), "latency": m.latency_stats(calls, accuracy),
        "latency_box": m.latency_box(calls, accuracy), "tokens": m.token_means(calls), "baseline": m.majority_baseline(truth), "distribution": m.class_distribution(truth), "significance": m.significance_run1(flags), "mcnemar": m.mcnemar_pairs(flags),
        "errors": error_kinds(calls, m.GROUP),
    }
    models = {r.model for r in calls.select("model").distinct().collect()}  # a handful
    if primary[0] in models and (fallbacks := sorted(models - set(primary))):
        tables["hybrid"], tables["hybrid_best"] = hybrids(calls, truth, primary[0], fallbacks, named)
    if emails is not None:
        tables["generator_bias"] = m.generator_bias(flags.where("dataset = 'synthetic'"), emails.select("id", "generator"), families or {})
        tables["intent_agreement"] = m.intent_agreement(emails.select("id", "intent"), truth)
    return tables


def evaluation_report(spark: SparkSession, sf_dir: str, path: str) -> None:
    log = fx.decision_log(spark, sf_dir)
    synthetic = fx.emails(log).join(log.where("dataset = 'synthetic'").select("id").distinct(), "id", "left_semi")
    write_report(report_tables(log, materialized(fx.truth(log)), synthetic, fx.FAMILIES), path)
