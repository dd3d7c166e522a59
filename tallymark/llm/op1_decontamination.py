"""Benchmark decontamination by greedy string tiling.

A text and a benchmark item become candidates when they share seeds, Karp-Rabin fingerprints of
``min_match`` successive tokens. Seeds that many items have (a common preamble) make no candidates as long as an
item's commonest seeds alone can't reach the coverage: a text that reaches it has one of the item's
other seeds too, so nothing is lost. For each candidate pair, the longest common run of tokens not yet marked is
found by fingerprints of that length and marked, again and again, until no run of ``min_match`` tokens is left. Tiles may
come in any order, so a passage whose sentences were reordered is found as well as a verbatim one. A text is
contaminated when the tiles cover enough of an item. Tokens are words without case and outer punctuation.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import block_count, bounded_batches, column, hash_words, split_words, table, window_hashes, written

_OUTER = re.compile(r"^[\W_]+|[\W_]+$")
#: Seeds of a benchmark that tasks may hold whole; a larger benchmark is joined by a shuffle.
MAX_HELD_SEEDS = 2_000_000
#: Parts of a seed in the join of larger benchmarks; texts and items of one task of it, in bytes.
SALTS, TASK_BYTES = 16, 16 << 20
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, and offsets by text; words of punctuation alone are no tokens."""
    index, offsets, words = split_words(texts, lower=False)
    bare = [_OUTER.sub("", w.decode().lower()).encode() for w in words]
    h = hash_words(bare)[index] if len(index) else np.empty(0, np.uint64)
    real = np.array([bool(w) for w in bare], bool)[index] if len(index) else np.empty(0, bool)
    return h[real], np.concatenate([[0], np.cumsum(real, dtype=np.int64)])[offsets]


def _runs(sums: np.ndarray, powers: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of all windows of n tokens from those of all beginnings."""
    return sums[n:] - sums[:-n] * powers[n]


def greedy_tiles(item: np.ndarray, text: np.ndarray, k: int, used: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Tiles ``(start in item, start in text, length)``, longest first, ties by position in the item, then in the text.

    ``used`` marks tokens of the text that no tile may have. Memory grows with both lengths, not with their product.
    """
    marks = [np.zeros(len(item), bool), np.zeros(len(text), bool) if used is None else used.copy()]
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(len(item), len(text)), _BASE)]), dtype=np.uint64)
    sums = []
    for x in (item, text):
        # Beginnings as polynomials: the base is odd, so it has an inverse modulo 2 ** 64.
        inverse = np.cumprod(np.full(len(x), _INVERSE), dtype=np.uint64)
        sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * inverse, dtype=np.uint64)]) * powers[: len(x) + 1])
    tiles, top = [], min(len(item), len(text))

    def common(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of free windows of n tokens that the other side has too, and their fingerprints."""
        at, prints = [], []
        for m, h in zip(marks, sums, strict=True):
            free = np.concatenate([[0], np.cumsum(m)])
            at.append(np.flatnonzero(free[n:] == free[:-n]))
            prints.append(_runs(h, powers, n)[at[-1]])
        both = np.intersect1d(*prints)
        here = [np.isin(x, both) for x in prints]
        return at[0][here[0]], prints[0][here[0]], at[1][here[1]], prints[1][here[1]]

    while top >= k:
        low, high = k - 1, top
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if len(common(mid)[0]) else (low, mid - 1)
        n = low
        if n < k:
            break
        starts, prints, places, found = common(n)
        order = np.argsort(found, kind="stable")
        places, found = places[order], found[order]
        first = {int(f): [int(a), int(b)] for f, a, b in zip(np.unique(found), np.searchsorted(found, np.unique(found)), np.searchsorted(found, np.unique(found), side="right"), strict=True)}
        for i, f in zip(starts.tolist(), prints.tolist(), strict=True):
            if marks[0][i] or marks[0][i + n - 1]:  # all tiles of this round are as long, so an overlap shows at an end
                continue
            left = first[f]
            while left[0] < left[1] and (marks[1][j := int(places[left[0]])] or marks[1][j + n - 1]):
                left[0] += 1
            if left[0] < left[1] and np.array_equal(item[i : i + n], text[j : j + n]):
                marks[0][i : i + n] = marks[1][j : j + n] = True
                tiles.append((i, j, n))
        top = n - 1
    return tiles


def needed_seeds(seeds: np.ndarray, items_with: np.ndarray, k: int, least: float) -> np.ndarray:
    """Which windows of an item make it a candidate: all but the commonest, which together cover fewer than ``least`` tokens."""
    needed = np.ones(len(seeds), bool)
    reach = np.zeros(len(seeds) + k - 1, bool)
    distinct, which = np.unique(seeds, return_inverse=True)
    shared = np.zeros(len(distinct), np.int64)
    shared[which] = items_with
    places = np.split(np.argsort(which, kind="stable"), np.cumsum(np.bincount(which))[:-1])
    for s in np.lexsort((distinct, -shared)):
        if shared[s] < 2:
            break
        spot = (places[s][:, None] + np.arange(k)).ravel()
        if reach.sum() + (~reach[np.unique(spot)]).sum() >= least:
            break
        reach[spot] = True
        needed[places[s]] = False
    return needed


class Benchmark:
    """The items' tokens and seeds, and the seeds that make candidates."""

    def __init__(self, ids: list, texts: list, k: int, coverage: float):
        h, offsets = tokens_of(pa.array(texts, pa.string()))
        self.k, self.ids, self.coverage = k, ids, coverage
        self.tokens = [h[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        seeds, at = window_hashes(h, offsets, k)
        item = np.searchsorted(offsets, at, side="right") - 1
        cut = np.searchsorted(item, np.arange(len(ids) + 1))
        self.seeds = [seeds[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        distinct, which = np.unique(seeds, return_inverse=True)
        by_item = np.unique(np.stack([which, item]), axis=1)[0]
        items_with = np.bincount(by_item, minlength=len(distinct))[which]
        needed = np.concatenate([needed_seeds(s, items_with[a:b], k, coverage * len(t)) for s, a, b, t in zip(self.seeds, cut[:-1], cut[1:], self.tokens, strict=True)] or [np.zeros(0, bool)])
        order = np.lexsort((item[needed], seeds[needed]))
        self.keys, self.item = seeds[needed][order], item[needed][order]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def candidates(self, windows: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
        """Pairs of text and item that share a seed which makes candidates."""
        maybe = np.flatnonzero(self.sieve[(windows >> np.uint64(44)).astype(np.int64)])
        low, high = np.searchsorted(self.keys, windows[maybe]), np.searchsorted(self.keys, windows[maybe], side="right")
        once = np.unique(np.stack([owner[maybe], low, high])[:, high > low], axis=1).T.tolist()
        return sorted({(o, int(x)) for o, a, b in once for x in self.item[a:b]})

    def tiled(self, x: int, text: np.ndarray, windows: np.ndarray) -> int:
        """Tokens of an item that tiles of a text cover, 0 if the seeds show that they are too few."""
        item, own, k = self.tokens[x], self.seeds[x], self.k
        hit = np.isin(windows, own)
        reach, near = np.zeros(len(item), bool), np.zeros(len(text), bool)
        for marks, at in ((reach, np.flatnonzero(np.isin(own, windows[hit]))), (near, np.flatnonzero(hit))):
            for t in range(k):
                marks[at + t] = True
        if reach.sum() < self.coverage * len(item):
            return 0
        return sum(n for *_, n in greedy_tiles(item, text, k, ~near))


def covered(bench: Benchmark, texts: pa.Array, pairs: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int, int]]:
    """``(index of text, index of item, tokens covered, tokens of item)`` for every pair (of those given) that reaches the coverage."""
    h, offsets = tokens_of(texts)
    windows, at = window_hashes(h, offsets, bench.k)
    cut = np.searchsorted(at, offsets)
    if pairs is None:
        pairs = bench.candidates(windows, np.searchsorted(offsets, at, side="right") - 1)
    out = []
    for o, x in pairs:
        got = bench.tiled(x, h[offsets[o] : offsets[o + 1]], windows[cut[o] : cut[o + 1]])
        if got and got >= bench.coverage * len(bench.tokens[x]):
            out.append((o, x, got, len(bench.tokens[x])))
    return out


_FOUND = "doc_id long, item_id long, n_covered long, n_item_tokens long"


def _pairs(batches, bench: Benchmark):
    for batch in batches:
        ids = column(batch, "doc_id").to_pylist()
        found = covered(bench, column(batch, "text"))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([ids[o] for o, *_ in found], [bench.ids[x] for _, x, *_ in found], [c for *_, c, _ in found], [n for *_, n in found])], names=["doc_id", "item_id", "n_covered", "n_item_tokens"])


def _seed_rows(batches, key: str, k: int):
    """Each text's distinct seeds."""
    for batch in batches:
        h, offsets = tokens_of(column(batch, "text"))
        windows, at = window_hashes(h, offsets, k)
        owner, seed = np.unique(np.stack([np.searchsorted(offsets, at, side="right") - 1, windows.view(np.int64)]), axis=1)
        yield pa.RecordBatch.from_arrays([column(batch, key).take(pa.array(owner)), pa.array(seed)], names=[key, "seed"])


def _verified(texts: pa.Table, pairs: pa.Table, k: int, coverage: float) -> pa.Table:
    """The pairs of one task's texts and items that reach the coverage; texts and items stand once each."""
    at = {x: i for i, x in enumerate(column(texts, "text_key").to_pylist())}
    items, of = {}, []
    for text_key, item_key, item_id, item in zip(*(column(pairs, c).to_pylist() for c in ("text_key", "item_key", "item_id", "item")), strict=True):
        of.append((at[text_key], items.setdefault(item_key, (len(items), item_id, item))[0]))
    keys = list(items)
    bench = Benchmark([x[1] for x in items.values()], [x[2] for x in items.values()], k, coverage)
    text_keys = list(at)
    out = [(text_keys[o], keys[x], bench.ids[x], c, n) for o, x, c, n in covered(bench, column(texts, "text"), sorted(set(of)))]
    return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names=["text_key", "item_key", "item_id", "n_covered", "n_item_tokens"])


def _text_key(text: str = "text") -> Column:
    """Stands for a text in joins, whatever ids its rows have; null texts count as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _joined_pairs(docs: DataFrame, benchmark: DataFrame, k: int, coverage: float) -> DataFrame:
    """``(text_key, item_key, item_id, n_covered, n_item_tokens)`` for every distinct text that covers an item.

    An item's key is made of its id and text, null-safe; an item that stands repeatedly gives repeated rows. Only
    seeds meet in the join by seed, where each is dealt into parts; then every candidate text is sent once, whatever
    the number of items it shares seeds with.
    """
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", _text_key())
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long"), F.col("text").alias("item"))
    items = written(items.withColumn("item_key", F.unhex(F.sha2(F.to_json(F.struct("item_id", "item")), 256))))
    once = items.dropDuplicates(["item_key"])
    seeds = written(once.select("item_key", F.col("item").alias("text")).mapInArrow(lambda b: _seed_rows(b, "item_key", k), "item_key binary, seed long"))
    counted = seeds.groupBy("seed").agg(F.count("*").alias("items_with")).where("items_with > 1")
    shared = seeds.join(counted, "seed").groupBy("item_key").agg(F.map_from_entries(F.collect_list(F.struct("seed", "items_with"))).alias("shared"))

    def needed(batches):
        for pdf in batches:
            for key, item, of in zip(pdf["item_key"], pdf["item"], pdf["shared"], strict=True):
                h, offsets = tokens_of(pa.array([item], pa.string()))
                own = window_hashes(h, offsets, k)[0]
                of = {int(a): int(b) for a, b in of.items()} if of is not None else {}
                keep = needed_seeds(own, np.array([of.get(x, 1) for x in own.view(np.int64).tolist()], np.int64), k, coverage * len(h))
                yield pd.DataFrame({"item_key": key, "seed": np.unique(own[keep].view(np.int64))})

    makers = once.join(shared, "item_key", "left").select("item_key", "item", "shared").mapInPandas(needed, "item_key binary, seed long")
    makers = makers.withColumn("part", F.explode(F.array(*map(F.lit, range(SALTS)))))
    met = texts.mapInArrow(lambda b: _seed_rows(b, "text_key", k), "text_key binary, seed long").withColumn("part", F.pmod(F.xxhash64("text_key"), F.lit(SALTS)).cast("int"))
    pairs = written(met.join(makers, ["seed", "part"]).select("text_key", "item_key").distinct())
    wanted = written(texts.join(pairs.select("text_key").distinct(), "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text")))
    full = written(pairs.join(once.select("item_key", "item_id", "item"), "item_key"))
    size = (wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0) + (full.agg(F.sum(F.octet_length("item"))).first()[0] or 0)
    bucket = F.pmod(F.xxhash64("text_key"), F.lit(block_count(size, TASK_BYTES))).alias("bucket")
    verified = wanted.select("*", bucket).groupBy("bucket").cogroup(full.select("*", bucket).groupBy("bucket")).applyInArrow(
        lambda t, p: _verified(t, p, k, coverage), "text_key binary, item_key binary, item_id long, n_covered long, n_item_tokens long"
    )
    return verified.join(items.select("item_key"), "item_key")


def _held(benchmark: DataFrame, k: int, coverage: float) -> Benchmark | None:
    """The benchmark, if it has few enough seeds for each task to hold; each seed takes a token of five bytes or so."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text")
    if (items.agg(F.sum(F.length("text"))).first()[0] or 0) > 5 * MAX_HELD_SEEDS:
        return None
    rows = items.collect()
    return Benchmark([r[0] for r in rows], [r[1] for r in rows], k, coverage)


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, coverage: float = 0.5) -> DataFrame:
    """``(doc_id, item_id, n_covered, n_item_tokens, coverage)`` for every text whose tiles cover that share of an item.

    ``docs(doc_id, text)``, ``benchmark(item_id, text)``. Null and empty texts match nothing, nor do
    items of fewer than ``min_match`` tokens. Repeated rows give repeated results. A benchmark of up to
    MAX_HELD_SEEDS seeds goes to every task; a larger one meets the texts in a join on seeds, with the
    same results: there texts and items are joined by keys of what they are, not by ids. Texts may be of any length; a
    repeated word costs no more than another.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if (bench := _held(benchmark, min_match, coverage)) is not None:
        shared = docs.sparkSession.sparkContext.broadcast(bench)
        found = texts.mapInArrow(lambda b: _pairs(b, shared.value), _FOUND)
    else:
        keyed = docs.select(F.col("doc_id").cast("long"), _text_key().alias("text_key"))
        found = keyed.join(_joined_pairs(docs, benchmark, min_match, coverage), "text_key").select("doc_id", "item_id", "n_covered", "n_item_tokens")
    return found.withColumn("coverage", F.col("n_covered") / F.col("n_item_tokens"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, coverage: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that cover no item, with all their columns; null and empty texts stay."""
    if (bench := _held(benchmark, min_match, coverage)) is None:
        bounded_batches(docs.sparkSession)
        bad = _joined_pairs(docs, benchmark, min_match, coverage).select(F.col("text_key").alias("_bad_key")).distinct()
        return docs.join(bad, _text_key() == F.col("_bad_key"), "left_anti")
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(bench)

    def kept(batches):
        for batch in batches:
            mask = np.ones(batch.num_rows, bool)
            mask[[o for o, *_ in covered(shared.value, column(batch, "text"))]] = False
            yield batch.filter(pa.array(mask))

    return docs.mapInArrow(kept, docs.schema)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
