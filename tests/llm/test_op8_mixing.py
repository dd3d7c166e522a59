import re
from collections import defaultdict

import numpy as np
import pytest

from tallymark.llm import op8_mixing as m


def test_permutation_and_inverse():
    for n in (1, 2, 3, 7, 64, 1000):
        p = m.permuted(np.arange(n), n, 5)
        assert sorted(p) == list(range(n)) and (m.permuted(p, n, 5, back=True) == np.arange(n)).all()
    assert (m.permuted(np.arange(1000), 1000, 5) != m.permuted(np.arange(1000), 1000, 6)).any()


def water_fill(sizes, weights, share, most):
    """Brute force: caps sources until none is above."""
    left, unit = share * sum(sizes), 0.0
    under = {i for i, s in enumerate(sizes) if s > 0}
    while under:
        unit = left / sum(weights[i] for i in under)
        over = {i for i in under if unit * weights[i] > most * sizes[i]}
        if not over:
            break
        left -= sum(most * sizes[i] for i in over)
        under -= over
    return [unit * weights[i] if i in under else most * s for i, s in enumerate(sizes)]


@pytest.mark.parametrize(("sizes", "weights", "share"), [([10, 100, 5], [5, 2, 1], 1.5), ([0, 10, 1], [5, 2, 1], 1.5), ([10], [5], 1.5), ([1, 1, 1000], [5, 2, 1], 1.9), ([3, 4, 5], [5, 2, 1], 2.5), ([0, 0], [5, 2], 1.5), ([2**i for i in range(12)], [5, 2, 1] * 4, 1.5)])
def test_water_level(spark, sizes, weights, share):
    sources = spark.createDataFrame([(s, float(w)) for s, w in zip(sizes, weights, strict=True)], "source_size long, weight double")
    unit = m.water_level(sources, share, 2)
    t = [min(unit * w, 2 * s) for s, w in zip(sizes, weights, strict=True)]
    assert sum(t) == pytest.approx(min(share, 2) * sum(sizes))
    assert t == pytest.approx(water_fill(sizes, weights, share, 2))
    units = {round(x / w, 6) for x, w, s in zip(t, weights, sizes, strict=True) if s and x < 2 * s - 1e-9}
    assert len(units) <= 1 and all(2 * s / w <= min(units) + 1e-6 for x, w, s in zip(t, weights, sizes, strict=True) if units and s and x >= 2 * s - 1e-9)


def brute_targets(rows):
    size = defaultdict(int)
    for _, s, t in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    return size, dict(zip(names, water_fill([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2), strict=True))


@pytest.mark.parametrize("block", [4, 7, 128])
def test_mix_meets_targets(spark, block):
    rows = [(i, ["a", "b", "é", None, "z"][i % 5 if i % 3 else 0], " ".join(["w"] * (i * 37 % 90))) for i in range(200)]
    rows += [(500, "empty", ""), (501, "empty", None), (7, "b", "one two"), (7, "b", "one two"), (None, "a", "x y z")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, size int")
    got = m.mix(docs, block_words=block, shard_slots=16, rows_per_bucket=20).collect()
    size, target = brute_targets(rows)
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 0.5001 for s in size)
    again = m.mix(docs.repartition(7), block_words=block, shard_slots=16, rows_per_bucket=20).collect()
    assert sorted(got, key=str) == sorted(again, key=str)
    assert m.mix(docs.limit(0)).count() == 0


def test_taken_equals_counting_word_by_word(spark):
    rows = [(i, ["a", "b", None][i % 3 if i % 7 else 0], " ".join(["w"] * (i * 29 % 70))) for i in range(150)] + [(3, "a", "q r"), (3, "a", "q r")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    block = 8
    sized = m.sized_rows(docs)
    sources = m.plan_sources(sized, (5, 2, 1), 1.5, 2.0, block, 1)
    plan = sources.orderBy("source_no").toPandas()
    assert plan["first_slot"].tolist() == [0, *plan["n_slots"].cumsum()][:-1]
    size = dict(zip(plan["source_no"], plan["source_size"], strict=True))
    uses = defaultdict(int)  # of every word, by source and place
    slots = m.draw_slots(spark, sources, 16, 1).collect()
    assert sorted(map(str, slots)) == sorted(map(str, m.draw_slots(spark, sources, 16, 1, max_held=0).collect()))
    for r in slots:
        words = range(r.block * block, min(size[r.source_no], (r.block + 1) * block))
        for w in words[: r.words] if r.words is not None else words:
            uses[r.source_no, w] += 1
    for i, n in zip(plan["source_no"], plan["n_slots"], strict=True):
        own = [(r.pass_no, r.block) for r in slots if r.source_no == i]
        assert len(own) == len(set(own)) == n
    placed = m.placed_rows(sized, sources, 20).collect()
    for i, n in size.items():
        assert sorted(w for r in placed if r.source_no == i for w in range(r.first_word, r.first_word + r["size"])) == list(range(n))
    want = sorted((r.doc_id, r["size"], sum(uses[r.source_no, w] for w in range(r.first_word, r.first_word + r["size"]))) for r in placed)
    assert sorted((r.doc_id, r["size"], r.taken) for r in m.mix(docs, block_words=block, shard_slots=16, rows_per_bucket=20).collect()) == want


def test_sums_in_stretches(spark):
    df = spark.range(5000).selectExpr("id % 3 as s", "id as at", "id % 7 as n")
    got = {(r.s, r.at): r.x for r in m.summed_before(df, "s", "at", "n", "x", 100).collect()}
    total = defaultdict(int)
    for i in range(5000):
        assert got[i % 3, i] == total[i % 3]
        total[i % 3] += i % 7


def test_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source", "text").collect()]
    size, target = brute_targets(rows)
    got = m.op8_mixing(spark, small).collect()
    assert {r.doc_id: r["size"] for r in got} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, _, t in rows}
    for s in size:
        assert abs(sum(r.taken for r in got if r.source == s) - target[s]) <= 0.5001
    assert all(r.taken <= 2 * r["size"] for r in got)


def test_more_sources_than_a_task_holds(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', cast(id as string)) as source", "repeat('w ', cast(id % 40 as int)) as text")
    want = sorted(map(str, m.mix(docs, block_words=8, shard_slots=64).collect()))
    monkeypatch.setattr(m, "MAX_HELD_SOURCES", 100)
    got = m.mix(docs, block_words=8, shard_slots=64).collect()
    assert sorted(map(str, got)) == want
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
    assert all(abs(taken[r.source] - r.target) <= 0.5001 for r in got)
