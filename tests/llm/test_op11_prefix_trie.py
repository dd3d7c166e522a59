import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tallymark.llm import op11_prefix_trie as m

SCHEMA = "conv_id long, turn long, role string, text string"


def key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def ordered(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, key(role or "", text or ""), role or "", text or ""))
    return {c: [x[3:] for x in sorted(turns)] for c, turns in convs.items()}


def rebuilt(rows):
    convs, out = ordered(rows), {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    below = defaultdict(list)
    for prefix in nodes:
        for d in range(len(prefix) + 1):
            below[prefix[:d]].append(prefix)
    children = {p: sum(len(q) == len(p) + 1 for q in below[p]) for p in nodes}
    out = []
    for p, members in nodes.items():
        saved = sum((len(nodes[q]) - 1) * (len(q[-1][1]) if q else 0) for q in below[p])
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children[p], sum(not children[q] for q in below[p]), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def odd_rows():
    rng = random.Random(3)
    rows = []
    for c in range(-210, 420, 7):
        for t in range(rng.randrange(0, 7)):
            rows.append((c, t if rng.random() > 0.1 else None, rng.choice(["user", "assistant", None]), rng.choice(["", "a", "b", "grüße 😀", None])))
    for c in (0, 100, 200, 300):
        rows += [(c, t, "user", "hello") for t in range(3)]
    rows += [(None, 1, "user", "x"), (5, 1, "user", "x"), (5, 1, "user", "x"), (5, None, None, None)]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1040) for t in range(9)]  # copies
    rows += [(2001, t, "user", "y" * 5000 if t == 3 else f"t{t % 3}") for t in range(300)]  # one long conversation
    return rows


def test_trie_of_odd_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    turns = m.ordered_turns(df)
    assert rows_of(m.prefix_trie(*m.with_shared_heads(turns))) == brute(rebuilt(rows))
    assert rows_of(m.prefix_trie(*m.as_they_are(turns))) == brute(ordered(rows))


def test_positions_go_on_over_ranges(spark):
    rows = [(c, t, "u", "ab") for c, n in ((1, 3), (2, 5000), (3, 1), (4, 200)) for t in range(n)]
    random.Random(1).shuffle(rows)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = m.ordered_turns(spark.createDataFrame(rows, SCHEMA)).groupBy("conv_id").agg({"position": "max", "upto": "max", "*": "count"}).collect()
        each = m.ordered_turns(spark.createDataFrame(rows, SCHEMA)).where("position * 2 = upto").count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert {(r[0], r["max(position)"], r["max(upto)"], r["count(1)"]) for r in got} == {(1, 3, 6, 3), (2, 5000, 10000, 5000), (3, 1, 2, 1), (4, 200, 400, 200)}
    assert each == len(rows)


def test_empty_and_extra_columns(spark):
    none = m.ordered_turns(spark.createDataFrame([], SCHEMA))
    assert m.prefix_trie(*m.with_shared_heads(none)).count() == 0
    one = spark.createDataFrame([(7, 1, "user", "hi", 1, {"a": 1})], SCHEMA + ", depth int, key map<string,int>")
    assert rows_of(m.prefix_trie(*m.as_they_are(m.ordered_turns(one)))) == brute({7: [("user", "hi")]})


def test_members_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(m, "PIECE", 7)
    rows = [(c, 0, "user", "same") for c in range(5, 105)]
    convs = {c: [("user", "same")] for c in range(5, 105)}
    assert rows_of(m.prefix_trie(*m.as_they_are(m.ordered_turns(spark.createDataFrame(rows, SCHEMA))))) == brute(convs)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(m.op11_prefix_trie(spark, f"/root/testdata/{sf}")) == brute(rebuilt(rows))
