import math
import re
from collections import Counter

import numpy as np
import pytest

from tallymark.llm import op5_quality_rules as m


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


@pytest.mark.parametrize("text", [None, "", " \t", "a b c a b c", "a\n\na\n a\na", "x\x0bx x\x0cx", "é# <b>|& %", "a a a a", "q\x85r\x1cs"])
def test_counts(text):
    assert m.counts_of(text)[:5] == brute(text)


def test_binomial_tail_is_exact():
    for n, k, p in [(10, 0, 0.1), (50, 3, 0.05), (300, 2, 0.01), (40, 39, 0.5), (5, 5, 0.2), (2000, 40, 0.02)]:
        assert m.binomial_tail(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)


def test_cutoffs_keep_their_promise():
    """In a world whose true loss is known, few fits lose more than alpha; all scores count together."""
    rng = np.random.default_rng(0)
    draw = lambda a, b, n: np.minimum((rng.beta(a, b, (5, n)) * m.STEPS).astype(int), m.STEPS)
    table = lambda x: np.stack([np.bincount(r, minlength=m.STEPS + 1) for r in x])
    broken = used = 0
    for _ in range(100):
        path = m.tightenings(table(draw(2, 6, 300)), table(draw(4, 2, 150)))
        assert path
        held, fresh = draw(2, 6, 900), draw(2, 6, 20000)
        gone, truth, lost = np.zeros(900, bool), np.zeros(20000, bool), []
        for s, c in path:
            gone |= held[s] > c
            lost.append(gone.sum())
        n = m.steps_taken(np.array(lost), 900, 0.02, 0.05)
        for s, c in path[:n]:
            truth |= fresh[s] > c
        used += n > 0
        broken += truth.mean() > 0.02
    assert broken <= 12 and used >= 60
    assert m.steps_taken(np.array([0, 0]), 100, 0.02, 0.05) == 0 and m.steps_taken(np.array([0, 0]), 150, 0.02, 0.05) == 2


def brute_kept(docs, labels, risk):
    """The whole method over plain rows ``(doc_id, text, lang)`` and ``(doc_id, quality)``."""
    told = {}
    for i, q in labels:
        if i is not None and q is not None:
            told[i] = told.get(i, False) or q > 0
    counts = np.array([m.counts_of(t) for _, t, _ in docs])
    steps, failed = m.steps_of(counts).tolist(), m.base_failed(counts).tolist()
    groups = {}
    for (i, t, lang), s, f in zip(docs, steps, failed, strict=True):
        if i in told and not f:
            w = re.sub("[A-Z]", lambda x: x[0].lower(), t).split()
            key = min(int(m.window_hashes(m.hash_words([x.encode() for x in w[j : j + 5]]), np.array([0, 5]), 5)[0][0]) for j in range(len(w) - 4))
            groups.setdefault(key, []).append((told[i], (lang is not None, lang or ""), s))
    rows = {k: (any(g for g, *_ in v), *min((x[1:] for x in v))) for k, v in groups.items()}
    keys = np.array(list(rows), np.uint64).view(np.int64).tolist()
    return rows, keys, steps, failed


def test_kept_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    for risk in (m.Risk(), m.Risk(alpha=0.05, min_labels=100)):
        docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").collect()]
        labels = [tuple(r) for r in spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality").collect()]
        labels += [labels[0], (labels[1][0], 1), (None, 1), (-5, 0)]
        rows, keys, steps, failed = brute_kept(docs, labels, risk)
        df = spark.createDataFrame(list(enumerate(keys)), "n long, k long").selectExpr("n", f"pmod(xxhash64(k), {risk.choosing}) = 0 as c").collect()
        chooses = dict(zip(rows, (r.c for r in sorted(df)), strict=True))
        good_in = {}
        for k, (g, (known, lang), _) in rows.items():
            if g and known and not chooses[k]:
                good_in[lang] = good_in.get(lang, 0) + 1
        stratum = lambda known, lang: lang if known and good_in.get(lang, 0) >= risk.min_labels else None
        strata = {stratum(*x) for g, x, _ in rows.values()}
        cuts = {}
        for z in strata:
            own = [(k, g, s) for k, (g, x, s) in rows.items() if stratum(*x) == z]
            count = lambda want, own=own: np.array([np.bincount([s[i] for k, g, s in own if chooses[k] and g == want], minlength=m.STEPS + 1) for i in range(5)])
            path = m.tightenings(count(True), count(False))
            held = [s for k, g, s in own if g and not chooses[k]]
            taken = 0
            while taken < len(path):
                lost = sum(any(s[i] > c for i, c in path[: taken + 1]) for s in held)
                if sum(math.comb(len(held), x) * risk.alpha**x * (1 - risk.alpha) ** (len(held) - x) for x in range(lost + 1)) > risk.delta / len(strata):
                    break
                taken += 1
            cuts[z] = path[:taken]
        want = {i: not f and not any(s[x] > c for x, c in cuts.get(stratum(lang is not None, lang), [])) for (i, _, lang), s, f in zip(docs, steps, failed, strict=True)}
        got = m.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int"), risk)
        assert {r.doc_id: r.kept for r in got.collect()} == want
        assert any(cuts.values()) and sum(not f for f in failed) > sum(want.values())


def test_judge_and_stage_agree(spark):
    clean = [" ".join(f"word{i}x{j}" for j in range(80)) for i in range(900)]
    noisy = [" ".join(f"w{i}x{j}#$%" for j in range(80)) for i in range(200)]
    rows = [(i, t, "en", 1) for i, t in enumerate(clean)] + [(1000 + i, t, "en", 0) for i, t in enumerate(noisy)]
    odd = [(5000, None, None), (5001, "", "en"), (5002, "short text", "xx"), (5003, clean[0], None), (5003, clean[0], None)]
    docs = spark.createDataFrame([r[:3] + (1,) for r in rows] + [o + (1,) for o in odd], "doc_id long, text string, lang string, _allowed int")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(5003, None)], "doc_id long, quality int")
    risk = m.Risk(alpha=0.1, min_labels=100)
    got = {r.doc_id: r for r in m.judge(docs, labels, risk).collect()}
    assert all(got[i].kept for i in range(900)) and not any(got[1000 + i].kept for i in range(200))
    assert not got[5000].kept and got[5000].n_words == 0 and not got[5001].kept and got[5002].base_failed and got[5003].kept
    assert sorted(r.doc_id for r in m.keep_good(docs, labels, risk).collect()) == sorted(r.doc_id for r in m.judge(docs, labels, risk).collect() if r.kept)
    assert m.keep_good(docs, labels, risk).columns == docs.columns
    assert m.judge(docs.limit(0), labels).count() == 0
    assert m.judge(docs, labels.limit(0)).where("kept").count() == 1102


def test_very_long_text_and_many_strata(spark):
    long = "word and other " * 100_000
    rows = [(1, long, "en"), (2, " ".join(f"v{i}" for i in range(300_000)), None)] + [(10 + i, " ".join(f"x{i}y{j}" for j in range(60)), f"lang{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in m.judge(docs, docs.selectExpr("doc_id", "1 as quality"), m.Risk(min_labels=1)).collect()}
    assert got[1].n_repeat_words == 300_000 and got[1].base_failed and got[2].kept and got[2].n_words == 300_000
    assert sum(r.kept for r in got.values()) == 301


def test_query_matches_brute_force(spark, small):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    got = m.op5_quality_rules(spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        b = brute(texts[r.doc_id])
        assert tuple(r[1:6]) == b and r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0]) and not (r.kept and r.base_failed)
