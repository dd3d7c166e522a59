"""URL filters by association rules.

Fixed rules of host and path decide the pages they fit; those decisions are the labels. Spark's
FP-growth mines which combinations of URL tokens go with which label. A rule's confidence is the lower bound
of Wilson's interval, so that rules of few pages are not sure ones. Rules below the thresholds of
support and confidence are pruned, and so is every rule that one of a token less makes superfluous. A token that
goes with one label alone makes every longer rule superfluous, so such tokens don't enter combinations. Tokens that the same
pages have are one token, so what always comes together makes no combinations. Nothing else bounds them: rules of any length
are complete at the support, and where pages share many tokens freely, their number grows exponentially with these.
The remaining pages' token sets meet the rules by an inverted index from token to rule: a rule fits
when all its tokens are found.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import table, written


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))
#: Parts into which pages with the same tokens are dealt.
PARTS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and what follows; all empty for null and for URLs without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1)
    path = F.regexp_extract(after, r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path, F.regexp_extract(after, r"(?s)^[^?#]*(.*)$", 1)


def fitting_rule(rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits ``host`` and ``path``, as a struct of its text and verdict; null if none does."""
    found = F.lit(None).cast("struct<rule:string,listed:string>")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.host, r.path)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("listed"))).otherwise(found)
    return found


def url_tokens() -> Column:
    """Distinct tokens of ``host``, ``path`` and ``tail``: labels of the host, path segments with digits as #, ending, query keys."""
    labels = F.transform(F.split("host", r"\."), lambda x: F.concat(F.lit("host:"), x))
    top = F.array(F.concat(F.lit("top:"), F.element_at(F.split("host", r"\."), -1)))
    segments = F.transform(F.filter(F.split("path", "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), F.regexp_replace(F.lower(x), "[0-9]+", "#")))
    keys = F.transform(F.regexp_extract_all("tail", F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("query:"), F.lower(x)))
    return F.array_sort(F.array_distinct(F.concat(labels, top, segments, keys)))


def lower_bound(hits: Column, n: Column, z: float = 1.96) -> Column:
    """Of Wilson's interval for hits / n."""
    p, zz = hits / n, z * z
    return F.round((p + zz / (2 * n) - z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n), 9)


@dataclass(frozen=True)
class Mining:
    """Bounds of the rules that are mined: shares of all labelled pages and numbers of pages, lower bound of confidence.

    Tokens that more than ``max_share`` of the pages have tell nothing and are left out.
    """

    min_support: float = 0.005
    min_pages: int = 5
    min_confidence: float = 0.8
    max_share: float = 0.9


def least_hits(confidence: float, z: float = 1.96) -> int:
    """No rule of fewer pages has this lower bound, even if all go with its label: hits / (hits + z * z) is below it."""
    low = confidence - 1e-9  # bounds are rounded
    return max(0, math.ceil(z * z * low / (1 - low)) - 1) if low < 1 else 0


def equal_tokens(kept: DataFrame, tokens: list[str]) -> dict[str, str]:
    """Of tokens that the same labelled pages have, the first stands for all: token to that one, for the others."""
    if not tokens:
        return {}
    seen = kept.select("row", F.explode(F.array_intersect("tokens", F.array(*map(F.lit, tokens)))).alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"))
    groups = seen.groupBy("n", "x", "y").agg(F.array_sort(F.collect_list("token")).alias("t")).where("size(t) > 1").collect()
    return {x: r.t[0] for r in groups for x in r.t[1:]}


def mapped(tokens: Column, same: dict[str, str]) -> Column:
    """Tokens with those that stand for them in their place."""
    if not same:
        return tokens
    names = F.create_map(*(F.lit(x) for pair in same.items() for x in pair))
    return F.array_distinct(F.transform(tokens, lambda x: F.coalesce(names[x], x)))


def combinations(baskets: DataFrame, support: int, labels: list[str]) -> DataFrame:
    """``(items, verdict, hits, n)`` of all combinations from ``baskets(items)`` that ``support`` pages of a label have.

    Items are numbers of tokens from 1 and, below 0, one of the page's label: -1 for the first of ``labels``.
    """
    share = (support - 0.5) / baskets.count()
    if share > 1:
        return baskets.sparkSession.createDataFrame([], "items array<int>, verdict string, hits long, n long")
    sets = FPGrowth(itemsCol="items", minSupport=share, minConfidence=0.0).fit(baskets).freqItemsets
    # A combination comes once alone, and once with each label that is frequent in it.
    sets = sets.select(F.array_sort("items").alias("all"), "freq").select(F.filter("all", lambda x: x > 0).alias("items"), F.when(F.col("all")[0] < 0, F.col("all")[0]).alias("label"), "freq").where("size(items) > 1")
    told = sets.groupBy("items").agg(F.max("freq").alias("n"), *(F.max(F.when(F.col("label") == -1 - i, F.col("freq"))).alias(f"hits_{i}") for i in range(len(labels))))
    each = F.array(*(F.struct(F.lit(x).alias("verdict"), F.col(f"hits_{i}").alias("hits")) for i, x in enumerate(labels)))
    return told.select("items", "n", F.explode(each).alias("x")).where("x.hits is not null").select("items", "x.verdict", "x.hits", "n")


def mine_rules(labelled: DataFrame, mining: Mining) -> tuple[DataFrame, dict[str, str]]:
    """``(tokens, verdict, confidence, hits)`` from ``labelled(tokens, listed)``, pruned, and which tokens stand for others in them."""
    spark = labelled.sparkSession
    kept = written(labelled.select("tokens", "listed").withColumn("row", F.monotonically_increasing_id()))
    n = kept.count()
    if not n:
        return spark.createDataFrame([], "tokens array<string>, verdict string, confidence double, hits long"), {}
    floor = max(mining.min_pages, math.ceil(mining.min_support * n))
    told = kept.select("listed", F.explode("tokens").alias("token")).groupBy("token", "listed").agg(F.count("*").alias("hits"))
    told = written(told.join(told.groupBy("token").agg(F.sum("hits").alias("n")), "token").where(F.col("n") <= mining.max_share * n))
    # As many as a page's tokens / min_support at most: each is on that share of the pages.
    both = sorted(r[0] for r in told.where((F.col("hits") < F.col("n")) & (F.col("n") >= floor)).select("token").distinct().collect())
    same = equal_tokens(kept, both)
    single = told.where((F.col("hits") >= floor) & ~F.col("token").isin(list(same))).select(F.array("token").alias("tokens"), F.col("listed").alias("verdict"), "hits", "n")
    rules = with_confidence(single)
    labels = sorted(r[0] for r in told.select("listed").distinct().collect())
    firsts, names = (F.array(*map(F.lit, x)).cast("array<string>") for x in ([x for x in both if x not in same], labels))
    items = kept.select(F.array_intersect("tokens", firsts).alias("t"), (-F.array_position(names, F.col("listed"))).cast("int").alias("label")).where("size(t) > 1")
    baskets = written(items.select(F.concat(F.transform("t", lambda x: F.array_position(firsts, x).cast("int")), F.array("label")).alias("items")))
    if baskets.limit(1).count():
        found = with_confidence(combinations(baskets, max(1, floor, least_hits(mining.min_confidence)), labels).withColumnRenamed("items", "tokens"))
        found = found.where(F.col("confidence") >= mining.min_confidence).withColumn("tokens", F.transform("tokens", lambda x: F.element_at(firsts, x)))
        rules = rules.unionByName(found)
    rules = written(rules.where(F.col("confidence") >= mining.min_confidence))
    parts = rules.select("tokens", "verdict", "confidence", F.explode("tokens").alias("x")).select("tokens", "verdict", "confidence", F.array_remove(F.col("tokens"), F.col("x")).alias("part"))
    known = rules.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("theirs"))
    needless = parts.join(known, ["part", "verdict"]).where("theirs >= confidence").select("tokens", "verdict").distinct()
    return rules.join(needless, ["tokens", "verdict"], "left_anti").select("tokens", "verdict", "confidence", "hits"), same


def with_confidence(sets: DataFrame) -> DataFrame:
    return sets.select("tokens", "verdict", "hits", lower_bound(F.col("hits"), F.col("n")).alias("confidence"))


def apply_rules(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``(tokens, mined)`` for the distinct token sets that some rule fits: the verdict of the surest, then best supported one."""
    index = rules.select(F.xxhash64("tokens", "verdict").alias("rule_id"), F.size("tokens").alias("needed"), "verdict", "confidence", "hits", F.explode("tokens").alias("token"))
    found = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token").groupBy("tokens", "rule_id", "needed", "verdict", "confidence", "hits").count().where("count = needed")
    return found.groupBy("tokens").agg(F.max_by("verdict", F.struct("confidence", "hits", "verdict")).alias("mined"))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, mining: Mining = Mining(), default: str = "allow") -> DataFrame:  # noqa: B008
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages(page_id, url)``; other columns are ignored.

    A listed rule decides where it fits, the longest first; elsewhere the surest mined rule (of equal
    ones the better supported, then the verdict later by name), else ``default``. Null URLs and those
    without ``://`` have empty host and path. Repeated rows are judged alike. URLs may be of any length.
    """
    urls = pages.select("page_id", F.col("url").alias("_url"))
    host, path, tail = url_parts(F.col("_url"))
    rows = urls.select("page_id", host.alias("host"), path.alias("path"), tail.alias("tail"))
    rows = rows.select("*", fitting_rule(rules).alias("r"), url_tokens().alias("tokens")).select("page_id", "host", "path", "r.rule", "r.listed", "tokens")
    mined, same = mine_rules(rows.where("listed is not null"), mining)
    mined = written(mined)
    # Every token of a rule is in min_support of the labelled pages, so there are at most a page's tokens / min_support.
    useful = [r[0] for r in mined.select(F.explode("tokens").alias("t")).distinct().collect()]
    told = F.array(*map(F.lit, sorted(useful))).cast("array<string>")
    other = rows.where("listed is null").select("page_id", "host", "path", F.array_intersect(mapped(F.col("tokens"), same), told).alias("tokens"))
    verdicts = apply_rules(other.select("tokens").distinct(), mined).withColumn("part", F.explode(F.array(*map(F.lit, range(PARTS)))))
    # Pages with one token set, or with none, may be a third of all: they are dealt into parts.
    judged = other.withColumn("part", F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(PARTS)).cast("int")).join(verdicts, ["tokens", "part"], "left")
    judged = judged.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("mined", F.lit(default)).alias("verdict"))
    return rows.where("listed is not null").select("page_id", "host", "path", "rule", F.col("listed").alias("verdict")).unionByName(judged)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
