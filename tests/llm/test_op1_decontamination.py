import random
import tracemalloc

import numpy as np
import pyarrow as pa

from tallymark.llm import op1_decontamination as m


def brute_tiles(item, text, k):
    """Greedy string tiling as published: scan all positions for the longest unmarked run, mark, repeat."""
    a, b, out = [False] * len(item), [False] * len(text), 0
    while True:
        best = (k - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            return out
        a[i : i + n] = b[j : j + n] = [True] * n
        out += n


def tokens(text):
    return m.tokens_of(pa.array([text]))[0].tolist()


def test_tiling_equals_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        item = [rng.choice("abcd") for _ in range(rng.randrange(5, 25))]
        text = [rng.choice("abcd") for _ in range(40)]
        cut = rng.randrange(len(item))
        text[5:5] = item[cut:] + ["z"] + item[:cut]
        bench = m.Benchmark([1], [" ".join(item)], 3, 0.01)
        got = m.covered(bench, pa.array([" ".join(text)]))
        want = brute_tiles(item, text, 3)
        assert (got[0][2] if got else 0) == want


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi rho sigma tau upsilon"


def test_reordered_and_odd_rows(spark, monkeypatch):
    w = ITEM.split()
    moved = " ".join(["Start", *w[10:], "and", *w[:10], "end."]).upper().replace("BETA", '"Beta,"')
    rows = [(1, moved), (2, None), (3, ""), (4, " ".join(w[:8]) + " nothing else here"), (5, ITEM), (5, ITEM), (None, ITEM), (7, "x " * 20000 + ITEM + " ...")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, item_id int, seed int")
    bench = spark.createDataFrame([(10, ITEM, 0), (11, None, 0), (12, "too short", 0), (13, ITEM, 0), (14, "", 0)], "item_id int, text string, doc_id int")
    for held in (10**6, 1):
        monkeypatch.setattr(m, "MAX_HELD_SEEDS", held)
        got = m.contaminated_pairs(docs, bench).collect()
        ids = [r.doc_id for r in got]
        assert sorted(ids, key=str) == [1, 1, 5, 5, 5, 5, 7, 7, None, None]
        assert sorted((r.doc_id for r in m.drop_contaminated(docs, bench).collect()), key=str) == [2, 3, 4]
        assert {r.n_covered for r in got if r.doc_id == 1} == {20}
    assert m.drop_contaminated(docs, bench).columns == docs.columns
    assert m.contaminated_pairs(docs.limit(0), bench).count() == 0 and m.contaminated_pairs(docs, bench.limit(0)).count() == 0


def test_large_benchmark_gives_the_same_rows(spark, monkeypatch):
    rows = [(1, ITEM), (None, ITEM), (None, "clean text"), (5, ITEM), (5, "a clean row of the same id"), (5, ITEM), (6, None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, item_id int, text_key string")
    bench = spark.createDataFrame([(10, ITEM), (None, ITEM), (10, "another item " + ITEM[:40]), (13, ITEM), (13, ITEM), (14, None)], "item_id int, text string")
    pairs, kept = [], []
    for held in (10**6, 1):
        monkeypatch.setattr(m, "MAX_HELD_SEEDS", held)
        pairs.append(sorted(map(tuple, m.contaminated_pairs(docs, bench).collect()), key=str))
        kept.append(sorted(map(tuple, m.drop_contaminated(docs, bench).collect()), key=str))
    assert pairs[0] == pairs[1] and kept[0] == kept[1]
    assert len([r for r in pairs[1] if r[0] is None]) == len([r for r in pairs[1] if r[0] == 1]) > 3
    assert sorted((r[0], r[1]) for r in kept[1] if r[0]) == [(5, "a clean row of the same id"), (6, None)] and len(kept[1]) == 3


def test_repeated_words_take_memory_by_length():
    bench = m.Benchmark([1, 2], ["x " * 3000, "y x " * 400], 5, 0.5)
    tracemalloc.start()
    got = m.covered(bench, pa.array(["x " * 300_000, "x y " * 50_000]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(0, 0, 3000, 3000), (1, 1, 800, 800)]
    assert peak < 300e6


def test_common_seeds_make_no_candidates_and_lose_nothing():
    rng = random.Random(8)
    pre = [f"p{i}" for i in range(12)]
    items = [" ".join([*pre, *(f"i{x}w{rng.randrange(40)}" for _ in range(20))]) for x in range(50)]
    bench = m.Benchmark(list(range(50)), items, 5, 0.5)
    texts = [" ".join([*pre, "other", "words"]), items[7], " ".join(pre + items[9].split()[20:]), "none of it"]
    want = [(o, x, brute_tiles(tokens(i), tokens(t), 5)) for o, t in enumerate(texts) for x, i in enumerate(items)]
    assert [g[:3] for g in m.covered(bench, pa.array(texts))] == [w for w in want if w[2] >= 0.5 * len(tokens(items[w[1]]))]
    h, offsets = m.tokens_of(pa.array(texts[:1]))
    assert bench.candidates(*(lambda w, at: (w, np.zeros(len(w), int)))(*m.window_hashes(h, offsets, 5))) == []


def test_query_matches_brute_force(spark, small):
    """Both ways, for whole texts; brute force looks at every pair that shares five tokens."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()
    parts = [(x.item_id, tokens(x.text)) for x in items]
    seeds = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for _, t in parts]
    want = set()
    for d in docs:
        t = tokens(d.text)
        own = [tuple(t[i : i + 5]) for i in range(len(t) - 4)]
        for (x, it), s in zip(parts, seeds, strict=True):
            if hits := [i for i, w in enumerate(own) if w in s]:
                # Tokens that no shared window has can be in no tile; one of them stands for each gap.
                near = sorted({i + j for i in hits for j in range(5)})
                part = [y for a, b in zip([None, *near], near, strict=False) for y in ([-1] if a is not None and b != a + 1 else []) + [t[b]]]
                if brute_tiles(it, part, 5) >= 0.5 * len(it):
                    want.add((d.doc_id, x))
    assert want and {(r.doc_id, r.item_id) for r in m.op1_decontamination(spark, small).collect()} == want
