import math
import random

import numpy as np
import pytest

from tallymark.llm import op13_exact_topk as m

SCHEMA = "vec_id long, embedding array<float>"


def whole(v):
    return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(64 * float(np.float32(x))) for x in v]


def brute(rows, k=20, every=20):
    vs = [(i, w) for i, v in rows if i is not None and (w := whole(v)) is not None]
    out = []
    for a, (i, q) in enumerate(vs):
        if i % every == 0:
            found = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(vs) if b != a)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in df.collect())


def search(df, **more):
    vectors = m.quantised(df)
    return m.top_k(vectors, vectors.where("vec_id % 20 = 0"), **more)


def test_odd_rows(spark):
    rng = random.Random(2)
    near = lambda: [round(rng.gauss(0, 0.1), 2) for _ in range(8)]
    rows = [(i, near()) for i in range(150)]
    rows += [(i, [0.25, -0.5, 0.0, 0.0, 0.1, 0.0, 0.0, 0.3]) for i in range(150, 260)]  # one very common vector
    rows += [(20, near()), (40, rows[40][1]), (40, rows[40][1])]  # ids and rows that repeat
    rows += [(300, None), (320, [1.0, None]), (340, [float("nan")]), (360, [float("inf"), 0.0]), (380, []), (400, [0.5]), (None, [9.0] * 8), (-20, [-0.4] * 8), (401, [0.1] * 12)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert rows_of(search(df)) == want
    assert rows_of(search(df, block_entries=200, query_entries=30)) == want
    assert rows_of(search(df.selectExpr("*", "1 as query", "'x' as vector", "map(1,1) as ids"), block_entries=500)) == want


def test_few_and_no_rows(spark):
    assert search(spark.createDataFrame([], SCHEMA)).count() == 0
    assert search(spark.createDataFrame([(0, [1.0])], SCHEMA)).count() == 0
    assert rows_of(search(spark.createDataFrame([(0, [1.0]), (1, [-1.0])], SCHEMA))) == [(0, 1, 1, -4096)]


def test_large_components(spark):
    rows = [(i, [float(2**20 * (i % 7) - 3), -1.5 * i, 2.0**18]) for i in range(200)]
    assert rows_of(search(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_proof_leaves_out_no_member(seed):
    """Most vectors are left out before all postings are read, and never one of the best."""
    rng = np.random.default_rng(seed)
    data = np.floor(64 * rng.normal(0, 0.125, (3000, 64))).astype(np.int64)
    if seed == 2:
        data = rng.integers(-3, 4, (3000, 64))  # many ties
    block, scored = m.Block(data), []
    for q in data[:40]:
        possible = block._possible(q.astype(float), 20)
        scores = data @ q
        least = np.sort(scores)[-20]
        assert set(np.flatnonzero(scores >= least)) <= set(possible)
        scored.append(len(possible))
    assert np.mean(scored) < 0.3 * len(data)


def test_query_on_test_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert rows_of(m.op13_exact_topk(spark, small)) == brute(rows)
