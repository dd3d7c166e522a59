"""Quality rules whose cutoffs are chosen so that few good texts are rejected, with a guarantee.

Every text gets five badness scores between 0 and 1. Labelled texts are split by a hash: one part chooses,
the other is the holdout. For each stratum (language), the choosing part gives an order in which cutoffs
are tightened, those first that reach most bad texts for each good one. On the holdout the tightenings
are tested in that order, all scores together: an exact binomial test must reject "more than alpha of
the good texts are lost". The first failure stops the sequence, so its steps need no correction; across
strata the error probability is split evenly (Bonferroni). With probability 1 - delta, then, no
stratum loses more than alpha of its good texts to the cutoffs. A stratum for which the labels prove
nothing gets no cutoff and rejects nothing. Of near copies one counts, so that the tested texts are independent.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import SEPARATORS, WORD_PATTERN, bounded_batches, column, hash_words, split_words, table, window_hashes, written

SCORES = ("symbols", "duplicate_lines", "repeated_words", "long_words", "short_words")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Steps of the grid of cutoffs.
STEPS = 128
_WORD = re.compile(WORD_PATTERN)


@dataclass(frozen=True)
class Risk:
    """At most ``alpha`` of a stratum's good texts are lost, with probability ``1 - delta``.

    Languages with fewer than ``min_labels`` good texts in the holdout form one stratum together; without any loss
    a stratum needs log(delta / strata) / log(1 - alpha) of them. One labelled text in ``choosing`` chooses.
    """

    alpha: float = 0.02
    delta: float = 0.05
    min_labels: int = 300
    choosing: int = 4


def counts_of(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The counts in COUNTS, and the number of lines that have a word."""
    text = text or ""
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if x.strip(SEPARATORS)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        first: dict = {}
        covered = np.zeros(len(words), bool)
        for i, w in enumerate(windows):
            if (j := first.setdefault(w, i)) != i:
                covered[i : i + 3] = True
                covered[j : j + 3] = True
        repeated = int(covered.sum())
    return len(words), len(text) - sum(text.count(c) for c in SEPARATORS), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeated, len(lines)


def steps_of(counts: np.ndarray) -> np.ndarray:
    """The step of each score (columns as in SCORES), from rows of counts_of()."""
    words, chars, symbols, dup, repeated, lines = counts.T.astype(float)
    n = np.maximum(words, 1)
    mean = chars / n
    scores = np.stack([symbols / (symbols + n), dup / np.maximum(lines, 1), repeated / n, mean / (mean + 8), 4 / (mean + 4)], axis=1)
    return np.minimum((scores * STEPS).astype(int), STEPS)


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


def copy_keys(texts: pa.Array) -> np.ndarray:
    """The least hash of each text's five-word shingles, which near copies mostly share; 0 for fewer words."""
    index, offsets, words = split_words(texts)
    h = hash_words(words)[index] if len(index) else np.empty(0, np.uint64)
    windows, at = window_hashes(h, offsets, 5)
    out = np.zeros(len(offsets) - 1, np.uint64)
    first, owner = np.unique(np.searchsorted(offsets, at, side="right") - 1, return_index=True)
    if len(first):
        out[first] = np.minimum.reduceat(windows, owner)
    return out.view(np.int64)


def _measured(batches):
    for batch in batches:
        counts = np.array([counts_of(t) for t in column(batch, "text").to_pylist()], np.int64).reshape(-1, 6)
        yield pa.RecordBatch.from_arrays(
            [column(batch, "doc_id"), column(batch, "lang"), *(pa.array(counts[:, i]) for i in range(5)), pa.array(base_failed(counts)), pa.array(steps_of(counts).tolist(), pa.list_(pa.int32())), pa.array(copy_keys(column(batch, "text")))],
            names=["doc_id", "lang", *COUNTS, "base_failed", "steps", "copy_key"],
        )


def measure(docs: DataFrame) -> DataFrame:
    """Counts, base verdict, score steps and key of near copies of every row of ``docs(doc_id, text, lang)``."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text", "lang").mapInArrow(_measured, f"doc_id long, lang string, {' long, '.join(COUNTS)} long, base_failed boolean, steps array<int>, copy_key long")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), by the continued fraction of the incomplete beta function."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    if x >= (a + 1) / (a + b + 2):
        a, b, x, flip = b, a, p, True
    else:
        flip = False
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    f = d
    for m in range(1, 10_000):
        for e in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + e * d, 1 + e / c
            d, c = 1 / (d if abs(d) > 1e-300 else 1e-300), c if abs(c) > 1e-300 else 1e-300
            f *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    value = f * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    return 1 - value if flip else value


def tightenings(good: np.ndarray, bad: np.ndarray) -> list[tuple[int, int]]:
    """``(score, highest step allowed)`` one after another; ``good`` and ``bad`` count texts by score and step.

    Next comes what reaches most bad texts for each good one (and one more), the lower score in ties; what doesn't
    find bad texts rather than good ones is left out.
    """
    n_good, n_bad = good.sum(axis=1).max(), bad.sum(axis=1).max()
    cut, path = [STEPS] * len(good), []
    while True:
        best = (0.0, 0, 0, 0)
        for s, top in enumerate(cut):
            lost, found = np.cumsum(good[s, 1 : top + 1][::-1]), np.cumsum(bad[s, 1 : top + 1][::-1])
            for n in np.flatnonzero((bad[s, 1 : top + 1][::-1] > 0) & (found * n_good > lost * n_bad)):
                best = max(best, (found[n] / (lost[n] + 1), int(found[n]), -s, top - int(n) - 1))
        if not best[1]:
            return path
        cut[-best[2]] = best[3]
        path.append((-best[2], best[3]))


def steps_taken(lost: np.ndarray, n: int, alpha: float, delta: float) -> int:
    """How many tightenings pass, if the first i + 1 of them lose ``lost[i]`` of ``n`` good texts."""
    for i, x in enumerate(lost):
        if binomial_tail(int(x), n, alpha) > delta:
            return i
    return len(lost)


def _paths(pdf: pd.DataFrame) -> pd.DataFrame:
    seen = np.zeros((2, len(SCORES), STEPS + 1), np.int64)
    seen[:, pdf["score"].to_numpy(), pdf["step"].to_numpy()] = pdf["good"], pdf["bad"]
    path = tightenings(*seen)
    return pd.DataFrame({"stratum": [pdf["stratum"].iloc[0]], "path_scores": [[s for s, _ in path]], "path_steps": [[c for _, c in path]]})


def fit(measured: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> tuple[DataFrame, list[int]]:  # noqa: B008
    """Cutoffs from ``labels(doc_id, quality)``: 1 is good, 0 bad, null unlabelled; base failures are left out.

    Gives ``(lang, allowed)``, the highest step of each score in languages with a stratum of their own, and
    the same list for all others. Strata may be any number: histograms by stratum are fitted where they lie. A text
    labelled repeatedly, and a group of near copies, counts once; as good, if any label says so.
    """
    told = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
    each = measured.where("not base_failed").join(told, "doc_id").groupBy("copy_key").agg(F.bool_or("good").alias("good"), F.min(F.struct("lang", "steps")).alias("x"))
    held = written(each.select("good", "x.*", (F.pmod(F.xxhash64("copy_key"), F.lit(risk.choosing)) == 0).alias("chooses")))
    named = written(held.where("good and not chooses and lang is not null").groupBy("lang").count().where(F.col("count") >= risk.min_labels).select("lang", F.concat(F.lit("="), "lang").alias("stratum")))
    held = held.join(named, "lang", "left").withColumn("stratum", F.coalesce("stratum", F.lit("")))
    seen = held.where("chooses").select("stratum", "good", F.posexplode("steps").alias("score", "step")).groupBy("stratum", "score", "step").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    paths = written(seen.groupBy("stratum").applyInPandas(_paths, "stratum string, path_scores array<int>, path_steps array<int>"))
    rejected = F.transform(F.arrays_zip("path_scores", "path_steps"), lambda x, i: F.when(F.get("steps", x["path_scores"]) > x["path_steps"], i))
    lost = held.where("good and not chooses").join(paths, "stratum").select("stratum", F.coalesce(F.array_min(rejected), F.lit(-1)).alias("at")).groupBy("stratum", "at").count()
    both = written(lost.groupBy("stratum").agg(F.sum("count").alias("n"), F.collect_list(F.struct("at", "count")).alias("lost")).join(paths, "stratum"))
    each_delta = risk.delta / max(1, both.count())

    def tested(pdf: pd.DataFrame) -> pd.DataFrame:
        allowed = []
        for n, lost, scores, steps in zip(pdf["n"], pdf["lost"], pdf["path_scores"], pdf["path_steps"], strict=True):
            by = np.zeros(len(scores), np.int64)
            for x in lost:
                if x["at"] >= 0:
                    by[x["at"]] = x["count"]
            cut = [STEPS] * len(SCORES)
            for s, c in list(zip(scores, steps, strict=True))[: steps_taken(np.cumsum(by), int(n), risk.alpha, each_delta)]:
                cut[s] = int(c)
            allowed.append(cut)
        return pd.DataFrame({"stratum": pdf["stratum"], "allowed": allowed})

    cutoffs = written(both.mapInPandas(lambda batches: map(tested, batches), "stratum string, allowed array<int>"))
    pooled = cutoffs.where("stratum = ''").select("allowed").first()
    return cutoffs.where("stratum <> ''").select(F.expr("substring(stratum, 2)").alias("lang"), "allowed"), list(pooled[0]) if pooled else [STEPS] * len(SCORES)


def with_cutoffs(rows: DataFrame, cutoffs: DataFrame, pooled: list[int], name: str) -> DataFrame:
    """Adds the row's cutoffs as column ``name``. One row a stratum: broadcast if Spark finds the written table small enough."""
    of = cutoffs.select(F.col("lang").alias(f"{name}_lang"), F.col("allowed").alias(name))
    out = rows.join(of, rows["lang"] == of[f"{name}_lang"], "left").drop(f"{name}_lang")
    return out.withColumn(name, F.coalesce(name, F.array(*map(F.lit, pooled))))


def judge(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:  # noqa: B008
    """Counts, base verdict and ``kept`` of every row of ``docs(doc_id, text, lang)``; other columns are ignored.

    Null texts have no words and fail the base rule, as texts under 50 words do. A null language
    belongs to the pooled stratum. Repeated rows are judged alike; texts of any length are counted whole.
    """
    found = written(measure(docs))
    rows = with_cutoffs(found, *fit(found, labels, risk), "allowed")
    within = F.forall(F.zip_with("steps", "allowed", lambda a, b: a <= b), lambda x: x)
    return rows.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & within).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:  # noqa: B008
    """The rows of ``docs`` that judge() keeps, with all their columns."""
    name, columns = "_allowed", docs.columns
    while name in columns or f"{name}_lang" in columns:
        name = f"_{name}"
    rows = with_cutoffs(docs, *fit(measure(docs), labels, risk), name)

    def kept(batches):
        for batch in batches:
            counts = np.array([counts_of(t) for t in column(batch, "text").to_pylist()], np.int64).reshape(-1, 6)
            allowed = np.array(column(batch, name).to_pylist(), np.int64).reshape(-1, len(SCORES))
            good = batch.filter(pa.array(~base_failed(counts) & (steps_of(counts) <= allowed).all(axis=1)))
            yield good.select(columns)

    return rows.select(*columns, name).mapInArrow(kept, docs.schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
