import itertools
import math
import zlib

import numpy as np
import pytest

from tallymark.llm import op7_language_id as m

PIECES = {p: i for i, p in enumerate(["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "aba"])}


def all_sums(word, p):
    s, total = m.START + word, 0.0
    for cuts in itertools.product([0, 1], repeat=len(s) - 1):
        parts, at = [], 0
        for i, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append(s[at:i])
                at = i
        q = 1.0
        for x in parts:
            q *= p[PIECES[x]] if x in PIECES else p[-1] if len(x) == 1 else 0
        total += q
    return total


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.ones(len(PIECES) + 1), 3).T
    words = ["a", "ab", "abab", "bxa", "ababba", "x"]
    got = m.Lattice(words, PIECES).log_sums(p)
    for i, w in enumerate(words):
        for k in range(3):
            assert got[i, k] == pytest.approx(math.log(all_sums(w, p[:, k])))


def test_long_words_do_not_underflow():
    p = np.full((len(PIECES) + 1, 2), 1e-9)
    got = m.Lattice(["x" * 2000, "ab"], PIECES).log_sums(p)
    assert got[0] == pytest.approx(2001 * math.log(1e-9))
    assert got[1, 0] == pytest.approx(math.log(all_sums("ab", p[:, 0])))


def test_very_long_runs_and_many_languages(spark):
    p = np.full((len(PIECES) + 1, 50), 0.1)
    assert m.Lattice(["ab" * 100_000], PIECES).log_sums(p).shape == (1, 50)
    rows = [(i, f"word{'abcdefghijklmnopqrstuvwxyz'[i % 26] * 3} {chr(97 + i // 26)}zz " * 3, f"l{i:03}") for i in range(300)] + [(1000, "x" * 1_000_000, None), (1001, "wordaaa azz " * 100_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in m.identify(docs, held_out="false").collect()}
    assert len({r.lang_pred for r in got.values()}) > 256 and got[1001].lang_pred == "l000"


def test_expectations_raise_the_likelihood():
    words, counts = ["ab", "aba", "b", "abab"], np.array([5.0, 3, 1, 2])
    last = -math.inf
    for rounds in range(5):
        p = m.fit_language(words, counts, PIECES, rounds, 1e-6)
        now = float((m.Lattice(words, PIECES).log_sums(p[:, None])[:, 0] * counts).sum())
        assert now >= last - 1e-6
        last = now


def test_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", "en"), (-3, "123 !!", "en"), (-4, "²", None), (None, "the and of", None), (-5, "日本語" * 500, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in m.identify(docs.select("doc_id", "text", "lang").unionByName(odd)).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (-1, -2, -3, -4))
    assert got[None].lang_pred == "en" and got[-5].lang_pred in ("de", "en", "es", "fr")
    rows = docs.select("doc_id", "lang").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(got[r.doc_id].held_out == (r in held) and 0 <= got[r.doc_id].score <= 1 for r in rows)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b", None, 1)], "doc_id long, text string, lang string, score int")
    assert [tuple(r)[2:] for r in m.identify(docs).collect()] == [("und", 0.0)]
    assert m.identify(docs.limit(0)).count() == 0


def test_other_vocabularies_fit_or_fail(monkeypatch):
    """Pieces of 100 letters and more than 65536 pieces are told apart; what can't be packed is an error."""
    many = {f"▁{chr(0x4E00 + i // 300)}{chr(0x4E00 + i % 300)}": i for i in range(70_000)} | {"a" * 100: 70_000, "a": 70_001}
    p = np.full((len(many) + 1, 1), 0.05)
    p[70_000], p[many["▁丏丯"]] = 0.5, 0.25
    got = m.Lattice(["a" * 100, "丏丯"], many).log_sums(p)[:, 0]
    assert got[0] == pytest.approx(math.log(0.05 * 0.5)) and got[1] == pytest.approx(math.log(0.25 + 0.05**3))
    monkeypatch.setattr(m, "_longest", lambda names: 1 << 60)
    with pytest.raises(ValueError, match="lattice"):
        m.Lattice(["a"], many)


def test_the_sample_keeps_its_bound_for_any_number_of_texts(spark):
    docs = spark.range(200_000).selectExpr("'wort' as text", "'de' as lang", "xxhash64(id) as pick")
    seen = docs.where("pmod(pick, 9007199254740992) < 1500 / 200000 * 9007199254740992").count()
    assert 1300 < seen < 1700
