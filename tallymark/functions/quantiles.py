"""Percentiles by group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.storage import numbered


def exact_quantiles(df: DataFrame, group: list[str], value: str, shares: list[float]) -> DataFrame:
    """``(*group, q array)``: interpolated percentiles of groups of any size, by selecting ranks.

    Equal values are counted first. The distinct ones are dealt by ranges of (group, value) and know from the counts of the ranges
    before how many values lie below them, so the two values around a wanted rank are picked where they are: no task holds
    a group, and only two rows a percentile and group meet.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    below = numbered(counts, [F.col("v")], "below", amount=F.col("c"), within=tuple(group)).withColumn("below", F.col("below").cast("long"))
    totals = counts.groupBy(*group).agg(F.sum("c").alias("n"))
    wanted = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(s) * (F.col("n") - 1)).alias("at")) for i, s in enumerate(shares))))
    ranks = totals.select(*group, wanted.alias("w")).select(*group, "w.i", "w.at", F.explode(F.array_distinct(F.array(F.floor("w.at"), F.ceil("w.at")))).alias("rank"))
    hit = (F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("c"))
    found = below.join(ranks, group).where(hit)
    weight = F.when(F.floor("at") == F.ceil("at"), 1.0).when(F.col("rank") == F.floor("at"), F.ceil("at") - F.col("at")).otherwise(F.col("at") - F.floor("at"))
    each = found.groupBy(*group, "i").agg(F.sum(weight * F.col("v")).alias("q"))
    return each.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x.q).alias("q"))


def group_quantiles(df: DataFrame, group: list[str], value: str, shares: list[float], accuracy: int | None = None) -> DataFrame:
    """Percentiles by group, exact or, with ``accuracy``, approximate in one pass."""
    if accuracy is None:
        return exact_quantiles(df, group, value, shares)
    return df.groupBy(*group).agg(F.percentile_approx(value, shares, accuracy).alias("q"))
