"""Which messages of a mailbox export are used: exclusion, deduplication, the newest ones."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfc(names: pd.Series) -> pd.Series:
    """Composed Unicode form, which Spark has no function for."""
    return names.map(lambda x: unicodedata.normalize("NFC", x) if x is not None else None)


def folder_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def exclude_folders(messages: DataFrame, excluded: list[str], path: str = "mailbox_path", compose: bool = True) -> DataFrame:
    """Adds ``excluded``: is the folder or one of its ancestors on the list? Spelling, case and outer spaces don't matter."""
    listed = F.array(*(F.lit(unicodedata.normalize("NFC", x).strip().lower()) for x in excluded)).cast("array<string>")
    names = F.split(nfc(F.array_join(path, "\x00")), "\x00") if compose else F.col(path)
    return messages.withColumn("excluded", F.coalesce(F.exists(names, lambda x: F.array_contains(listed, folder_key(x))), F.lit(False)))


def drop_blocked(messages: DataFrame, blocked: DataFrame, key: str = "message_id") -> DataFrame:
    """Without the messages whose id is blocked anywhere; empty and null ids are never blocked."""
    ids = blocked.where(F.length(key) > 0).select(key).distinct()
    return messages.join(ids, key, "left_anti").select(messages.columns)


def dedupe_latest(messages: DataFrame, row_key: str, key: str = "message_id", received: str = "received") -> DataFrame:
    """The newest row of each message id, null dates last; rows without an id all stay.

    Such rows get a key of their own, so the empty id is no hot key.
    """
    own = F.when(F.length(key) > 0, F.concat(F.lit("m"), key)).otherwise(F.concat(F.lit("r"), F.col(row_key).cast("string")))
    w = Window.partitionBy("_key").orderBy(F.desc_nulls_last(received), row_key)
    return messages.withColumn("_key", own).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_key", "_n")


def latest_n(messages: DataFrame, n: int, row_key: str, source: str | None = None, received: str = "received") -> DataFrame:
    """The newest ``n`` rows that have a source; a top-n, not a sort of everything."""
    rows = messages.where(F.col(source).isNotNull()) if source else messages
    return rows.orderBy(F.desc_nulls_last(received), row_key).limit(n)


def export_names(limited: DataFrame, row_key: str, received: str = "received", unknown: str = "unbekannt") -> DataFrame:
    """Adds ``0001_2026-09-30.eml``-like names in order of date; meant for the few rows that a limit left."""
    number = F.row_number().over(Window.orderBy(F.desc_nulls_last(received), row_key)).cast("string")
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    return limited.withColumn("file_name", F.concat(padded, F.lit("_"), F.coalesce(F.date_format(received, "yyyy-MM-dd"), F.lit(unknown)), F.lit(".eml")))
