"""From raw documents to a mix for training, in five stages; each works on all that the one before kept.

quality: texts that the rules reject go. near_duplicates: of each group of near copies (five-word
shingles, similarity 0.8 or more) the document with the smallest id stays (without one: the first by its text's hash). decontaminate: texts that
cover a benchmark item go. secrets: secrets in texts are replaced by a mark. mix: how many words of
each document the mix takes; this last stage returns the operator's table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions.storage import numbered
from tallymark.llm.common import table, written
from tallymark.llm.op1_decontamination import drop_contaminated
from tallymark.llm.op5_quality_rules import keep_good
from tallymark.llm.op8_mixing import mix
from tallymark.llm.op9_jaccard_join import near_duplicates
from tallymark.llm.op10_secret_scan import redact


#: Ids of dropped copies that go to every task, eight bytes each.
MAX_BROADCAST_IDS = 2_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def with_row_ids(docs: DataFrame, name: str) -> DataFrame:
    """One row for each id and text, with a number ``name`` in the order of ids (null last) and of the texts' hashes.

    Of rows with the same id and text the one stays whose other columns, as JSON, come first: columns of
    any type will do, also maps, which have no order.
    """
    columns = docs.columns
    has_text, others = F.col("text").isNotNull(), F.struct(*(c for c in columns if c != "text"))
    keyed = docs.select("*", F.xxhash64(F.coalesce("text", F.lit(""))).alias(f"{name}_text"), F.struct(has_text, F.to_json(others)).alias(f"{name}_rank"))
    once = keyed.groupBy(F.col("doc_id").alias(f"{name}_id"), f"{name}_text").agg(F.min_by(F.struct(*columns), f"{name}_rank").alias("row"))
    order = [F.col(f"{name}_id").isNull(), F.coalesce(f"{name}_id", F.lit(0)), F.col(f"{name}_text")]
    return numbered(once, order, name).select("row.*", F.col(name).cast("long").alias(name))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row with the smallest id stays.

    Rows without an id, and different texts under one id, are documents of their own and come after smaller ids, in the order
    of their texts' hashes; a row that stands repeatedly counts once. Texts without words all stay. Other columns may
    have any name and type.
    """
    columns, key = docs.columns, "doc_id"
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count():
        key = "_row"
        while key in columns:
            key = f"_{key}"
        docs = written(with_row_ids(docs, key))
    groups = near_duplicates(docs.select(F.col(key).alias("doc_id"), "text"))
    gone = written(groups.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct())
    if gone.count() <= MAX_BROADCAST_IDS:  # else the texts are shuffled to their ids
        gone = F.broadcast(gone)
    return docs.join(gone, key, "left_anti").select(columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


STAGES = [("quality", quality), ("near_duplicates", one_of_each_group), ("decontaminate", decontaminate), ("secrets", secrets), ("mix", mixed)]

#: The stages' models can't be told in SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
