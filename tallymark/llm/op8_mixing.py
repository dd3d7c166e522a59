"""Mixing sources to target weights by fixed-length blocks.

Each source's words, its texts one after another, are cut into blocks of ``block_words`` words. For
every output shard, how many of its slots each source fills is a multinomial draw (sources may be any number); draws beyond a
source's quota are dropped and missing ones are dealt into further shards at the end, so that a
source's words meet its target exactly. A source's slots are numbered through and sent through its
pseudorandom permutation of block indices, once for every pass over the source, and the blocks are
joined by index. So no source is shuffled as one group, and everything is a function of the
seed and the rows: reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark.functions.storage import numbered
from tallymark.llm.common import WORD_PATTERN, table, written

#: Sources whose first slots go to every task, 16 bytes each; for more, draws are joined to their sources, with the same rows.
MAX_HELD_SOURCES = 1_000_000
_KEYS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def water_level(sources: DataFrame, share: float, most: float) -> float:
    """What a weight of 1 gets, when ``share`` times all sizes go out by weight and none above ``most`` times its size.

    Each round caps the sources that the level of the round before puts above; rounds grow with the logarithm of the sizes.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    unit = 0.0
    while True:
        over = F.lit(unit) * F.col("weight") > F.lit(float(most)) * F.col("source_size")
        sums = sources.where("source_size > 0").groupBy("weight").agg(F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)), F.count_if(~over)).orderBy("weight").collect()
        under = sum(weight * n for weight, _, n in sums)
        level = (share * total - most * sum(size for _, size, _ in sums)) / under if under else unit
        if level <= unit:
            return unit
        unit = level


def permuted(x: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at x, or its inverse: a Feistel network, walked until it lands inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    x = x.astype(np.uint64)
    out, todo = x.copy(), np.arange(len(x))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for key in _KEYS[::-1] if back else _KEYS:
            f = (((left if back else right) + np.uint64(seed % 2**32)) ^ key) * _KEYS[1]
            f = ((f ^ (f >> np.uint64(29))) * _KEYS[0] >> np.uint64(33)) & mask
            left, right = (right ^ f, left) if back else (right, left ^ f)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def quota(size: int, target: float, block: int, seed: int) -> tuple[int, int, int, int]:
    """Blocks of a source, slots it fills, words in its last slot (0: a whole block), all words it gives."""
    words = round(target)
    n = -(-size // block)
    passes, rest = divmod(words, size) if size else (0, 0)
    if not rest:
        return n, passes * n, 0, words
    short, at = n * block - size, int(permuted(np.array([n - 1]), n, seed, back=True)[0])
    m = -(-rest // block)
    if m > at:
        m = max(at + 1, -(-(rest + short) // block))
    before = (m - 1) * block - (short if m - 1 > at else 0)
    return n, passes * n + m, rest - before, words


def sized_rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size, text_hash)`` of every row, without the texts, written once."""
    return written(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")))


def summed_before(rows: DataFrame, by: str, at: str, amount: str, name: str, width: int = 1024) -> DataFrame:
    """Adds what ``amount`` adds up to over the rows of the same ``by`` with a smaller ``at`` (unique there).

    In two levels, by stretches of ``at`` and then over the stretches, so that no task sorts all rows of one ``by``.
    """
    rows = rows.withColumn("_stretch", F.floor(F.col(at) / width))
    total = rows.groupBy(by, "_stretch").agg(F.sum(amount).alias("_sum"))
    earlier = Window.partitionBy(by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(by, "_stretch", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_earlier"))
    inside = Window.partitionBy(by, "_stretch").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(name, F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return rows.join(total, [by, "_stretch"]).withColumn(name, F.col(name) + F.col("_earlier")).drop("_stretch", "_earlier")


def plan_sources(sized: DataFrame, weights: tuple[float, ...], share: float, most: float, block_words: int, seed: int) -> DataFrame:
    """One row a source, numbered by code point and null last: size, target, blocks, slots, words of its last slot, slots of all before."""
    found = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = numbered(found, [F.col("source").isNull(), F.coalesce("source", F.lit(""))], "nth").select("source", "source_size", (F.col("nth") - 1).cast("long").alias("source_no"))
    found = written(found.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("source_no") % len(weights) + 1).cast("int"))))
    target = F.least(F.lit(water_level(found, share, most)) * F.col("weight"), F.lit(float(most)) * F.col("source_size"))

    def with_quotas(batches):
        for pdf in batches:
            got = [quota(int(s), t, block_words, seed * 1_000_003 + int(i)) for i, s, t in zip(pdf["source_no"], pdf["source_size"], pdf["target"], strict=True)]
            yield pdf.assign(**{name: pd.Series([g[k] for g in got], index=pdf.index, dtype="int64") for k, name in enumerate(("n_blocks", "n_slots", "last_words"))})

    found = found.select("source", "source_no", "source_size", target.alias("target"))
    found = written(found.mapInPandas(with_quotas, "source string, source_no long, source_size long, target double, n_blocks long, n_slots long, last_words long"))
    return written(summed_before(found.withColumn("one", F.lit(1)), "one", "source_no", "n_slots", "first_slot").drop("one"))


def draw_counts(spark: SparkSession, plan: DataFrame, total: int, shard_slots: int, seed: int, max_held: int) -> DataFrame:
    """``(shard, source_no, n)``: how many of a shard's slots each source fills, a multinomial draw by the sources' slots.

    Each slot draws a place among all sources' slots; counting places by source makes the multinomial. Its cost
    is a shard's slots, however many sources there are.
    """
    filled = plan.where("n_slots > 0").select("source_no", "first_slot", "n_slots")

    def places(shard):
        return np.random.default_rng([seed, shard]).integers(0, total, min(shard_slots, total - shard * shard_slots))

    shards = spark.range(math.ceil(total / shard_slots))
    if plan.count() <= max_held:
        held = filled.orderBy("source_no").toPandas()
        numbers, first = held["source_no"].to_numpy(np.int64), held["first_slot"].to_numpy(np.int64)

        def counted(batches):
            for pdf in batches:
                for shard in pdf["id"]:
                    at, n = np.unique(np.searchsorted(first, places(shard), side="right") - 1, return_counts=True)
                    yield pd.DataFrame({"shard": shard, "source_no": numbers[at], "n": n})

        return shards.mapInPandas(counted, "shard long, source_no long, n long")

    def drawn(batches):
        for pdf in batches:
            for shard in pdf["id"]:
                yield pd.DataFrame({"shard": shard, "place": places(shard)})

    # Places are uniform, so stretches of them get about as many draws each, whatever the sources' sizes.
    stretch = lambda place: F.floor(place / F.lit(shard_slots))
    upto = F.col("first_slot") + F.col("n_slots")
    parts = filled.select("source_no", "first_slot", upto.alias("upto"), F.explode(F.sequence(stretch(F.col("first_slot")), stretch(upto - 1))).alias("stretch"))
    rows = shards.mapInPandas(drawn, "shard long, place long").withColumn("stretch", stretch(F.col("place")))
    return rows.join(parts, "stretch").where("place >= first_slot and place < upto").groupBy("shard", "source_no").agg(F.count("*").alias("n"))


def draw_slots(spark: SparkSession, plan: DataFrame, shard_slots: int, seed: int, max_held: int | None = None) -> DataFrame:
    """``(shard, source_no, pass_no, block, words)``, a row for each slot; ``words`` is null for a whole block."""
    total = plan.agg(F.sum("n_slots")).first()[0] or 0
    shards = max(1, math.ceil(total / shard_slots))

    def placed(batches):
        for pdf in batches:
            for shard, s, first, n, slots, blocks, last in pdf[["shard", "source_no", "first", "n", "n_slots", "n_blocks", "last_words"]].itertuples(index=False):
                j = np.arange(first, min(first + n, slots))
                if len(j):
                    words = pd.array(np.full(len(j), last), dtype="Int64")
                    words[(j < slots - 1) | (last == 0)] = pd.NA
                    yield pd.DataFrame({"shard": shard, "source_no": s, "pass_no": j // blocks, "block": permuted(j % blocks, int(blocks), seed * 1_000_003 + int(s)), "words": words})

    counts = draw_counts(spark, plan, total, shard_slots, seed, MAX_HELD_SOURCES if max_held is None else max_held)
    numbered_draws = written(summed_before(counts, "source_no", "shard", "n", "first"))
    # What the draws left short of the quota, in shards of the same length at the end.
    drawn = numbered_draws.groupBy("source_no").agg(F.sum("n").alias("drawn"))
    short = plan.where("n_slots > 0").join(drawn, "source_no", "left").select("source_no", F.coalesce("drawn", F.lit(0)).alias("drawn"), "n_slots").where("drawn < n_slots")
    more = short.select("source_no", F.explode(F.sequence("drawn", F.col("n_slots") - 1, F.lit(shard_slots).cast("long"))).alias("first"))
    draws = numbered_draws.select("shard", "source_no", "first", "n").unionByName(more.select(F.lit(shards).cast("long").alias("shard"), "source_no", "first", F.lit(shard_slots).cast("long").alias("n")))
    draws = draws.join(plan.select("source_no", "n_slots", "n_blocks", "last_words"), "source_no")
    # Slots are many more than these rows, so the rows are dealt out first, into tasks of a few shards each.
    return draws.repartition(max(1, math.ceil(shards / 8)), "shard", "first").mapInPandas(placed, "shard long, source_no long, pass_no long, block long, words long")


def placed_rows(sized: DataFrame, plan: DataFrame, rows_per_bucket: int) -> DataFrame:
    """Adds the source's number and each row's first word in its source's sequence.

    Running sums go by buckets of rows and then over the buckets, so a hot source is many tasks' work.
    """
    numbers = plan.select(F.col("source").alias("of"), "source_no", "source_size", "target")
    n = max(1, math.ceil(sized.count() / rows_per_bucket))
    # Its size is known, so that Spark broadcasts the sources' table if it is small.
    rows = sized.join(numbers, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(n)))
    sums = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("in_bucket"))
    sums = summed_before(sums, "source_no", "bucket", "in_bucket", "start").drop("in_bucket")
    inside = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(inside)).join(sums, ["source_no", "bucket"])
    return rows.select("doc_id", "source", "source_no", "size", "source_size", "target", (F.col("start") + F.col("upto") - F.col("size")).alias("first_word"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_words: int = 128, shard_slots: int = 4096, rows_per_bucket: int = 5_000, seed: int = 1) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` for every row of ``docs(doc_id, source, text)``.

    Weights repeat over the sources in code-point order, null last. ``taken`` counts the words of a row
    that the mix has, repeats included. Texts may be of any length; other columns are ignored. Null and empty texts have size 0 and nothing taken; a source
    of such texts alone has target 0. Repeated rows are rows like others. No row is taken more often
    than ``most`` says, rounded up to whole passes.
    """
    spark = docs.sparkSession
    sized = sized_rows(docs)
    plan = plan_sources(sized, weights, share, most, block_words, seed)
    slots = draw_slots(spark, plan, shard_slots, seed)
    uses = slots.groupBy("source_no", "block").agg(F.count_if(F.col("words").isNull()).alias("times"), F.coalesce(F.sum("words"), F.lit(0)).alias("part"))
    rows = written(placed_rows(sized, plan, rows_per_bucket))
    full = rows.where("size > 0").select("*", F.explode(F.sequence((F.col("first_word") / block_words).cast("long"), ((F.col("first_word") + F.col("size") - 1) / block_words).cast("long"))).alias("block"))
    start = F.greatest("first_word", F.col("block") * block_words) - F.col("block") * block_words
    end = F.least(F.col("first_word") + F.col("size"), (F.col("block") + 1) * block_words) - F.col("block") * block_words
    full = full.select("source_no", "first_word", "block", start.alias("a"), end.alias("b")).join(uses, ["source_no", "block"])
    given = full.select("source_no", "first_word", (F.col("times") * (F.col("b") - F.col("a")) + F.greatest(F.least("b", "part") - F.col("a"), F.lit(0))).alias("words"))
    given = given.groupBy("source_no", "first_word").agg(F.sum("words").alias("given"))
    # Rows without words share the place of the row after them, and have nothing to be given.
    taken = F.when(F.col("size") > 0, F.coalesce("given", F.lit(0))).otherwise(0).cast("long")
    return rows.join(given, ["source_no", "first_word"], "left").select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
