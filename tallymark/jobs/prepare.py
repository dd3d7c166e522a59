"""From a folder of mail files to records with pseudonyms and a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions import text
from tallymark.functions.storage import materialized, numbered
from tallymark.operators import pseudonyms as p
from tallymark.sources.files import read_eml, write_jsonl


def cleaned(parsed: DataFrame, limit: int = 2000) -> DataFrame:
    """Readable messages with clean subject and body, cut at ``limit``, numbered by ``position`` in the order of ids."""
    good = parsed.where("error is null").withColumn("subject", text.clean_inline(F.col("subject"))).withColumn("body", text.truncate_text(text.clean_body(F.col("body")), limit))
    rest = F.xxhash64("date", "subject", "body", "sender", "to", "cc")
    return numbered(good, [F.col("id"), rest], "position").drop("error")


def prepared(parsed: DataFrame, own_addr: str | None = None, recognize: p.Recognizer | dict[str, p.Recognizer] | None = None) -> tuple[DataFrame, DataFrame]:
    """Records with pseudonyms, and the summary's one row, of ``parsed`` messages as read_eml() gives them."""
    mails = materialized(cleaned(parsed))
    found = None
    if recognize is not None:
        texts = mails.select("id", F.explode(F.array(F.struct(F.lit(2).alias("field"), F.col("subject").alias("text")), F.struct(F.lit(3).alias("field"), F.col("body").alias("text")))).alias("x")).select("id", "x.*")
        found = p.name_spans(texts, recognize)
    records, stats = p.anonymize_corpus(mails, own_addr, found)
    records = materialized(records)
    tokens = p.header_names(mails, own_addr)[-1]
    return records, p.prepare_summary(records, stats, p.residual_audit(records), parsed.where("error is not null").count(), tokens)


def prepare(spark: SparkSession, folder: str, out: str, own_addr: str | None = None, recognize: p.Recognizer | dict[str, p.Recognizer] | None = None) -> None:
    """Reads the folder's ``.eml`` files; writes ``records`` as JSON lines and ``summary`` as JSON into ``out``."""
    records, summary = prepared(materialized(read_eml(spark, folder)), own_addr, recognize)
    write_jsonl(records, f"{out}/records")
    write_jsonl(summary, f"{out}/summary")
