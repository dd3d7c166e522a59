"""Written intermediate tables and numbering across partitions."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def materialized(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet to the session's checkpoint folder (a temporary one in a local session without one; an error on a cluster) and read back."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    path = f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str, amount: Column | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """Adds row numbers from 1 in an order without ties, over the whole table or ``within`` groups; or, with ``amount``, what was summed up before each row.

    A window over the table or over a hot group would be one task. Here rows are dealt by ranges, numbered
    inside each range, and shifted by the totals of the ranges before; only these totals, a row for each range and
    group in it, meet. The dealt rows are written in between, since range bounds are sampled.
    """
    keys = [*map(F.col, within), *order]
    columns = [f"_o{i}" for i in range(len(keys))]
    groups, inner = columns[: len(within)], columns[len(within) :]
    ranged = materialized(df.select("*", *(k.alias(c) for k, c in zip(keys, columns, strict=True))).repartitionByRange(*map(F.col, columns)).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *groups).orderBy(*inner)
    each = F.lit(1) if amount is None else amount
    totals = ranged.groupBy("_part", *groups).agg(F.sum(each).alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col("_part").alias("_at"), *(F.col(g).alias(f"_b{g}") for g in groups), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_at")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"_b{g}"))
    if amount is None:
        value = F.row_number().over(inside) + F.col("_before")
    else:
        value = F.coalesce(F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + F.col("_before")
    return ranged.join(before if within else F.broadcast(before), same).withColumn(name, value).select(*df.columns, name)
