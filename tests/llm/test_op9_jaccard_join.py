import random
import re

import duckdb
import numpy as np
import pytest

from tallymark.llm.components import connected_components
from tallymark.llm.op9_jaccard_join import ORACLE_SQL, near_duplicates, op9_jaccard_join, tile_links


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    comp = {i: i for i in sets}
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            c = len(sets[a] & sets[b])
            if c and 100 * c >= percent * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                lo, hi = sorted((comp[a], comp[b]))
                comp = {i: lo if v == hi else v for i, v in comp.items()}
    return sorted((i, len(sets[i]), comp[i]) for i in ids)


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_matches_brute_force(spark, k, percent):
    rng = random.Random(k)
    rows = [(1000 + i, t) for i, t in enumerate([None, "", "a b", "A  b", "a", "\t", "x " * 3000])]
    base = [[rng.choice("abcdefghijklmnop") + rng.choice("aeiou") for _ in range(60)] for _ in range(4)]
    shared = " ".join(rng.choice("xyz") + str(rng.randrange(50)) for _ in range(50))
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = rng.choice("qrstu")
        rows.append((i, " ".join(w[: rng.choice([60, 60, 57])]) + (f" {shared}" if i % 3 == 0 else "")))
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n int, block int")
    assert sorted(map(tuple, near_duplicates(df, k, percent, block_bytes=4000).collect())) == brute(rows, k, percent)


def test_odd_tables(spark):
    df = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "other words here now"), (7, None)], "doc_id long, text string")
    got = sorted(near_duplicates(df, 3, 90).collect(), key=str)
    assert sorted((r[0], r[2]) for r in got if r[0]) == [(5, 5), (5, 5), (7, 7)]
    assert sorted((r[2] for r in got if r[0] is None), key=str) == [5, None]
    assert near_duplicates(df.limit(0), 3, 90).count() == 0


def test_parts_of_a_tile_find_all(spark, monkeypatch):
    from tallymark.llm import op9_jaccard_join as m

    monkeypatch.setattr(m, "PART", 8)
    rng = random.Random(0)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(x if rng.random() > 0.025 else "zz" for x in base)) for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(df, 3, 90).collect())) == brute(rows, 3, 90)


def test_tile_links_leave_guests_apart():
    s = [np.arange(10, dtype=np.uint64)] * 3
    got = tile_links(np.array([1, 2, 3]), np.array([10, 10, 10]), np.array([False, False, True]), None, s, 90)
    assert len(got) == 2
    assert not tile_links(np.array([1, 2]), np.array([10, 10]), np.array([False, False]), None, s[:2], 90)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (200, 200)], "a long, b long")
    got = dict(map(tuple, connected_components(links).collect()))
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100}


def test_query_matches_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    assert sorted(map(tuple, op9_jaccard_join(spark, small).collect())) == sorted(con.execute(ORACLE_SQL).fetchall())
