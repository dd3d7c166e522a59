import random
import re
from collections import defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_op1_decontamination import brute_tiles, tokens  # noqa: E402

from tallymark.llm.op5_quality_rules import judge  # noqa: E402
from tallymark.llm.op10_secret_scan import redacted  # noqa: E402


def prose(seed, n=120):
    rng = random.Random(seed)
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


ITEM = " ".join(f"item{i}" for i in range(30))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, " ".join(prose(i)), "en", f"s{i % 3}", 0) for i in range(40)]
    near = prose(3)
    near[60] = "changed"
    rows += [(100, " ".join(near), "en", "s1", 0), (101, " ".join(prose(3)), "de", "s2", 0), (102, " ".join(prose(50)) + " " + ITEM, "en", "s1", 0), (103, " ".join(prose(51)) + " password=hunter2222 end", "en", "s0", 0), (104, "too short", "en", "s0", 0), (105, None, None, None, 0), (106, " ".join(["a", "b", "c"] * 60), "en", "s0", 0), (7, " ".join(prose(7)), "en", "s1", 0), (None, " ".join(prose(77)), "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_each_stage_takes_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        seen[name] = sorted((r.doc_id for r in docs.collect()), key=str)
    key = lambda x: sorted(x, key=str)
    kept = [*range(40), 7, 100, 101, 102, 103, None]
    assert seen["quality"] == key(kept)
    assert seen["near_duplicates"] == key([*range(40), 102, 103, None])
    assert seen["decontaminate"] == seen["secrets"] == key([*range(40), 103, None])
    assert "hunter2222" not in docs.where("doc_id = 103").first().text


def test_rows_without_id_and_texts_under_one_id(spark):
    long = " ".join(prose(9, 200_000))
    texts = {x: " ".join(prose(x)) for x in range(1, 7)}
    rows = [(1, texts[1]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (2, texts[1]), (3, texts[3]), (3, texts[4]), (3, texts[3]), (4, texts[4]), (5, None), (6, None), (None, ""), (7, long), (8, long + " more")]
    docs = spark.createDataFrame([(*r, "en", f"s{i}", 0, i) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, _row int")
    got = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert got.columns == docs.columns
    want = sorted([(1, texts[1]), (None, texts[2]), (3, texts[3]), (3, texts[4]), (5, None), (6, None), (None, ""), (7, long)], key=str)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == want
    again = corpus_pipeline.one_of_each_group(spark, docs.repartition(7), "")
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))


def test_columns_without_order(spark):
    """Maps and structs of them beside repeated rows and rows without id; names that the stage uses itself."""
    texts = {x: " ".join(prose(x)) for x in range(4)}
    rows = [(1, texts[1], {"a": 1}, ({"k": 2.5},), 0), (1, texts[1], {"a": 0}, None, 1), (1, texts[1], {"a": 0}, None, 1), (None, texts[2], None, ({},), 2), (None, texts[2], {"b": 3}, None, 3), (3, texts[3], {}, None, 4), (3, None, {}, None, 5), (3, "", {}, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row map<string,int>, row struct<m:map<string,double>>, component_id int")
    got = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert got.schema.simpleString() == docs.schema.simpleString()
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, texts[1]), (None, texts[2]), (3, texts[3]), (3, None)], key=str)
    again = corpus_pipeline.one_of_each_group(spark, docs.repartition(5), "")
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))


def test_run_keeps_what_a_brute_force_version_keeps(spark, small, tmp_path):
    """Quality's verdicts have a brute force of their own; groups, tiles and sizes are counted here pair by pair, over the tables and planted rows."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()
    near = prose(500, 200)
    rows = [(10_000, " ".join(near)), (10_001, " ".join([*near[:90], "changed", *near[91:]])), (10_002, " ".join(near).upper()), (10_003, " ".join(prose(501)) + " " + items[0].text), (10_004, " ".join(prose(502)) + " api_key=abcdef0123456789"), (10_005, " ".join([*near[:60], *prose(503)]))]
    planted = spark.createDataFrame(rows, "doc_id long, text string")
    d = str(tmp_path)
    docs.unionByName(planted, allowMissingColumns=True).write.parquet(f"{d}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{d}/{name}.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}

    verdicts = judge(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).where("kept").select("doc_id").collect()
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    ids = sorted(r[0] for r in verdicts)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    sets = {}
    for i in ids:
        w = re.sub("[A-Z]", lambda x: x[0].lower(), texts[i]).split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)}
    first = {i: i for i in ids}

    def root(i):
        while first[i] != i:
            i = first[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                first[high] = low
    kept = [i for i in ids if root(i) == i]
    parts = [tokens(x.text) for x in items]
    seeds = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in parts]

    def dirty(text):
        t = tokens(text)
        own = [tuple(t[i : i + 5]) for i in range(len(t) - 4)]
        for it, s in zip(parts, seeds, strict=True):
            if hits := [i for i, w in enumerate(own) if w in s]:
                at = sorted({i + j for i in hits for j in range(5)})
                part = [y for a, b in zip([None, *at], at, strict=False) for y in ([-1] if a is not None and b != a + 1 else []) + [t[b]]]
                if brute_tiles(it, part, 5) >= 0.5 * len(it):
                    return True
        return False

    want = {i: len(words(redacted(texts[i]))) for i in kept if not dirty(texts[i])}
    assert {i: r["size"] for i, r in got.items()} == want
    assert {10_000, 10_004, 10_005} <= set(want) and not {10_001, 10_002, 10_003} & set(want)


def test_run_agrees_with_the_parts_on_the_test_tables(spark, small):
    got = corpus_pipeline.run(spark, small).collect()
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    shingles = {}
    for r in got:
        t = redacted(texts[r.doc_id])
        assert r["size"] == len(words(t)) >= 1
        w = re.sub("[A-Z]", lambda x: x[0].lower(), texts[r.doc_id]).split()
        shingles[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    ids = sorted(shingles)
    assert not any(len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]) for x, a in enumerate(ids) for b in ids[x + 1 :])
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
    assert all(abs(taken[r.source] - r.target) <= 0.5001 for r in got)
