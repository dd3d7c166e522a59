import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tallymark.llm import op3_lm_score as m
from tallymark.llm.op3_lm_score import op3_lm_score, score_texts


def brute(rows, strength=m.STRENGTH):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", low(t))) for i, t in rows]
    train = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i, _ in docs]
    orders = len(strength) + 1
    grams, after = Counter(), Counter()
    for (_, w), ok in zip(docs, train, strict=True):
        if ok:
            s = ["<s>"] * (orders - 1) + [*w, None]
            for i in range(orders - 1, len(s)):
                for n in range(orders):
                    grams[tuple(s[i - n : i + 1])] += 1
                    after[tuple(s[i - n : i])] += 1
    n, v = after[()], sum(len(g) == 1 for g in grams)
    out = []
    for (i, w), ok in zip(docs, train, strict=True):
        s, base, score = ["<s>"] * (orders - 1) + [*w, None], 0.0, 0.0
        for j in range(orders - 1, len(s)):
            p = (grams[(s[j],)] + 1) / (n + v + 1)
            base += math.log10(p)
            for x, k in enumerate(strength, 1):
                p = (grams[tuple(s[j - x : j + 1])] + k * p) / (after[tuple(s[j - x : j])] + k)
            score += math.log10(p)
        out.append((i, not ok, len(w) + 1, sum(grams[(b,)] > 0 for b in [*w, None]), n, base, score))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert abs(g[5] - w[5]) < 1e-5 and abs(g[6] - w[6]) < 1e-5


def test_matches_brute_force_on_odd_rows(spark):
    rows = [(1, "The the cat\nsat"), (2, None), (3, ""), (4, "the cat sat"), (4, "the cat sat"), (None, "a\xa0b cat"), (5, "zzz unknown Ünder"), (6, "cat " * 5000), (7, "  \t ")] + [(i, f"the cat {i % 3} sat on it") for i in range(8, 40)]
    df = spark.createDataFrame([(i, t, 9, "x") for i, t in rows], "doc_id long, text string, block int, train string").drop("train")
    same(score_texts(df, block_bytes=200).collect(), brute(rows))
    assert score_texts(df.limit(0)).count() == 0


def test_over_a_million_contexts_in_one_block():
    n, k = (1 << 20) + 5000, m.STRENGTH
    docs = pa.table({"doc_id": pa.array([1, 2], pa.int64()), "text": [" ".join(f"w{i}" for i in range(n)), "w1 w2 unseen w3"], "train": [True, False]})
    long, short = m._scored(docs, m._answered(m._asked(docs, 0, 3, 1)), 1, n + 1, n + 1, k).to_pylist()
    p = 2 / (2 * n + 3)  # every word and the end stand once
    assert (long["n_tokens"], long["n_known"], short["n_known"]) == (n + 1, n + 1, 4)
    assert math.isclose(long["base_score"], (n + 1) * math.log10(p), rel_tol=1e-9)
    for x in k:
        p = (1 + x * p) / (1 + x)
    assert math.isclose(long["score"], (n + 1) * math.log10(p), rel_tol=1e-9)


def test_other_orders_and_packing(spark):
    rows = [(i, f"a b {i % 3} a b c {i % 5} d") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for strength in ((2.0,), (3.0, 2.0, 1.0)):
        same(score_texts(df, strength=strength, block_bytes=100).collect(), brute(rows, strength))
    x = np.array([0, 1, 255, 256, 2**40 - 1], np.uint64)
    assert (m._unpacked(m._packed(x, 5), 5) == x).all() and len(m._unpacked(m._packed(x[:0], 5), 5)) == 0
    assert m.sized_blocks(1 << 30) == 128 and m.sized_blocks(100 << 40) <= (100 << 40) // (64 << 20) + 1


def test_probabilities_add_up():
    """Over all words that may follow a context, with the unknown one."""
    rng = np.random.default_rng(0)
    n2, n3 = rng.integers(0, 4, 50), rng.integers(0, 3, 50)
    root = np.log10(rng.dirichlet(np.ones(50)))
    step = m.walk(root, np.stack([n2, n3]), np.stack([np.full(50, n2.sum()), np.full(50, n3.sum())]), m.STRENGTH)
    assert math.isclose((10.0**step).sum(), 1)


def test_rows_of_one_id_spread_over_blocks(spark, monkeypatch):
    seen = []
    real = spark.createDataFrame([(None, f"text number {i} of many") for i in range(400)], "doc_id long, text string")
    spy = type(real).groupBy
    monkeypatch.setattr(type(real), "groupBy", lambda self, *c: (seen.append(self) if c == ("block",) else None) or spy(self, *c))
    score_texts(real, block_bytes=1000)
    assert seen[0].select("block").distinct().count() > 1


def test_query_matches_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    same(op3_lm_score(spark, small).collect(), brute(rows))
