"""A controlled synthetic corpus: weighted scenarios, generators in turn, attributes, prompts, records.

Draws are functions of row number and seed, so any part of a corpus can be drawn again by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions.storage import numbered

_PRIME = 2_147_483_647


def drawn_number(row: Column, salt: int, seed: int) -> Column:
    """A whole number from 0 to below 2**31 - 1 from two multiplicative steps, the same in any engine. Draws of one row with other salts are not independent of it."""
    x = ((row + salt * 7919 + seed * 104_729 + 1) * 48_271) % _PRIME
    return (x * 69_621 + salt) % _PRIME


def uniform(row: Column, salt: int, seed: int) -> Column:
    """A number in [0, 1)."""
    return drawn_number(row, salt, seed) / F.lit(float(_PRIME))


def alias_table(weights: list[int]) -> list[tuple[int, int, int]]:
    """Walker's table for whole weights: ``(slot, own share, other)`` of ``len(weights)`` slots with as much room as all weights together.

    In slot s, draws below the own share go to s and the others to ``other``. Shares are whole numbers, so the table is exact.
    """
    n, room = len(weights), sum(weights)
    left = [w * n for w in weights]
    small = [i for i in range(n) if left[i] < room]
    large = [i for i in range(n) if left[i] >= room]
    table = {}
    while small and large:
        s, g = small.pop(), large[-1]
        table[s] = (s, left[s], g)
        left[g] -= room - left[s]
        if left[g] < room:
            small.append(large.pop())
    table |= {i: (i, room, i) for i in [*small, *large]}
    return [table[i] for i in range(n)]


def draw_scenarios(spark: SparkSession, n: int, scenarios: DataFrame, seed: int, most: int = 100_000) -> DataFrame:
    """``n`` rows with ``row`` from 0 and a scenario drawn by whole ``weight``; of ``scenarios(position, key, weight, ...)`` there are at most ``most``.

    One number a row: its place among the slots of the alias table, and what is left of it within the slot picks the slot's own scenario or its
    other one. Each row meets one slot by its number, so a draw costs the same for any number of scenarios; the table is broadcast, its size is checked.
    """
    listed = scenarios.orderBy("position", "key").limit(most + 1).collect()
    if not listed or len(listed) > most or sum(r.weight for r in listed) <= 0:
        raise ValueError(f"between 1 and {most} scenarios with some weight are needed, not {len(listed)}")
    room = sum(r.weight for r in listed)
    slots = spark.createDataFrame(alias_table([int(r.weight) for r in listed]), "slot long, own long, other long")
    numbered_ = spark.createDataFrame([(i, *r) for i, r in enumerate(listed)], T.StructType([T.StructField("at", T.LongType()), *scenarios.schema.fields])).drop("weight", "position")
    place = drawn_number(F.col("row"), 1, seed) * len(listed)
    rows = spark.range(n).select(F.col("id").alias("row")).select("row", F.floor(place / _PRIME).cast("long").alias("slot"), F.floor(place % _PRIME * room / _PRIME).cast("long").alias("v"))
    at = F.when(F.col("v") < F.col("own"), F.col("slot")).otherwise(F.col("other")).alias("at")
    return rows.join(F.broadcast(slots), "slot").select("row", at).join(F.broadcast(numbered_), "at").drop("at")


def round_robin_generator(drawn: DataFrame, pool: list[str], special_pool: list[str], special: str = "phishing") -> DataFrame:
    """Adds ``generator``: pools in turn, with counters of their own for rows that are special and those that aren't."""
    parts = []
    for flag, names in ((False, pool), (True, special_pool)):
        some = numbered(drawn.where(F.col(special) == flag), [F.col("row")], "turn")
        parts.append(some.withColumn("generator", F.element_at(F.array(*map(F.lit, names)), ((F.col("turn") - 1) % len(names) + 1).cast("int"))))
    return parts[0].unionByName(parts[1]).drop("turn")


def pick(values: tuple[str, ...], row: Column, salt: int, seed: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(uniform(row, salt, seed) * len(values)) + 1).cast("int"))


def draw_attributes(
    drawn: DataFrame, seed: int, industries: tuple[str, ...], lengths: tuple[str, ...], tones: tuple[str, ...], start: str = "2026-09-01 08:00:00", long_for: str = "", copies: tuple[str, ...] = (), mass: tuple[str, ...] = (), english: float = 0.15
) -> DataFrame:
    """Adds industry, length, tone, language, recipients and date. One scenario is always long; copies go to 3-40, mass mails to 500."""
    row = F.col("row")
    copy, many = F.col("key").isin(*copies), F.col("key").isin(*mass)
    days, minutes = F.floor(uniform(row, 6, seed) * 30), F.floor(uniform(row, 7, seed) * 601)
    return drawn.select(
        "*", F.concat(F.lit("S"), F.when(row + 1 < 1000, F.lpad((row + 1).cast("string"), 3, "0")).otherwise((row + 1).cast("string"))).alias("id"), pick(industries, row, 2, seed).alias("industry"),
        F.when(F.col("key") == long_for, lengths[-1]).otherwise(pick(lengths, row, 3, seed)).alias("length"), pick(tones, row, 4, seed).alias("tone"), F.when(uniform(row, 5, seed) < english, "englisch").otherwise("deutsch").alias("language"),
        (~copy & ~many).alias("direct"), F.when(copy, F.floor(uniform(row, 8, seed) * 38) + 3).when(many, 500).otherwise(1).cast("int").alias("recipients"), many.alias("is_list"),
        F.timestamp_seconds(F.unix_timestamp(F.lit(start)) + days * 86_400 + minutes * 60).alias("date"),
    )


def render_prompt() -> Column:
    # The prompt's lines.
    to = F.when(F.col("direct"), "direkt an mich").when(F.col("is_list"), "an einen Verteiler").otherwise("an andere, ich stehe nur in CC")
    return F.concat_ws(
        "\n", F.concat(F.lit("Szenario: "), "description"), F.concat(F.lit("Organisation des Empfängers: "), "industry"), F.concat(F.lit("Gesendet "), to, F.lit("; Datum "), F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss")),
        F.concat(F.lit("Länge: "), "length", F.lit("; Ton: "), "tone", F.lit("; Sprache: "), "language"), F.lit("Schreibe genau diese eine E-Mail."),
    )


MAIL = "sender string, subject string, text string, attachments bigint"


def valid_mail(raw: Column) -> Column:
    """Three texts that aren't blank and a whole number (not a boolean) of attachments, in JSON text."""
    kind = lambda f: F.schema_of_variant(F.try_parse_json(F.to_json(F.struct(F.try_variant_get(F.try_parse_json(raw), f"$.{f}", "variant").alias("v")))))
    ok = kind("attachments") == "OBJECT<v: BIGINT>"
    for f in ("sender", "subject", "text"):
        ok &= (kind(f) == "OBJECT<v: STRING>") & (F.trim(F.get_json_object(raw, f"$.{f}")) != "")
    return F.coalesce(ok, F.lit(False))


def assemble_record(specs: DataFrame, mails: DataFrame) -> DataFrame:
    """Specs with generated ``mails(id, raw, cost_usd)`` as records; intent and frame are nested and not part of what judges see."""
    mail = F.from_json("raw", MAIL)
    return specs.join(mails.where(valid_mail(F.col("raw"))), "id").select(
        "id", "date", mail["sender"].alias("sender"), "direct", "recipients", mail["subject"].alias("subject"), mail["text"].alias("text"), mail["attachments"].cast("int").alias("attachments"), "is_list", "generator", F.col("key").alias("scenario"),
        F.struct("urgency", "category", "reply_needed", "phishing").alias("intent"), F.create_map(*(x for c in ("industry", "length", "tone", "language") for x in (F.lit(c), F.col(c)))).alias("frame"), "cost_usd",
    )


def generation_progress(specs: DataFrame, written: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids still to generate (any written row counts), and one row of counts and cost; ``written(id, ok, cost_usd)``."""
    pending = specs.select("id").join(written.select("id"), "id", "left_anti")
    return pending, written.agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.count("*").alias("total"), F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0))), 6).alias("cost_usd"))
