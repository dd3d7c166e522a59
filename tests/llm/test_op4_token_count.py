from tokenizers import Tokenizer

from tallymark.llm import op4_token_count as m
from tallymark.llm.common import tokenizer_path

ODD = ["", " ", "a  b", " lead", "trail ", "a\n b", "a \n\nb", "x<|endoftext|>y <|endoftext|> z", "don't we'll I'M", "é ü b", "a\x1c b", "日本 語 テキスト", "   x", "\n\nx\n", "a" * 3000 + " " + "b " * 10, "1 22 333,4 !!! ?!", " em sp ace　x", "tab\tx y", "x" * 50 + " y"]


def library(texts):
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_odd_texts(spark, monkeypatch):
    for window in (5, 1 << 20):
        monkeypatch.setattr(m, "WINDOW_CHARS", window)
        monkeypatch.setattr(m, "REMEMBERED", 7)
        assert m.PartCounter(tokenizer_path("byte_bpe_50k.json")).count(ODD) == library(ODD)
    df = spark.createDataFrame([(1, None, 3), (None, "two words", 4), (1, None, 3)], "doc_id long, text string, n_tokens int")
    assert sorted(map(tuple, m.count_tokens(df, limit=1).collect()), key=str) == [(1, 0, 0, False), (1, 0, 0, False), (None, 9, 2, True)]
    assert m.count_tokens(df.limit(0)).count() == 0


def test_query_matches_library(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    want = {r[0]: n for r, n in zip(rows, library([r[1] for r in rows]), strict=True)}
    got = m.op4_token_count(spark, small).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)


def test_very_long_texts_without_spaces(monkeypatch):
    """Cut between letters and digits, parts add up to the whole."""
    import random

    from tokenizers import Tokenizer

    path = m.tokenizer_path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    rng = random.Random(2)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    texts = ["".join(rng.choices(alphabet + extra, k=5000)) for extra in ("", "+/", "日本é'", "\n\t ", "'s 't're") for _ in range(4)] + ["é1" * 2000, "日本語" * 1000, "a'1s'2t" * 500]
    monkeypatch.setattr(m, "WINDOW_CHARS", 50)
    counter = m.PartCounter(path)
    assert counter.count(texts) == [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]
    assert all(len(list(m.split_parts(t))) > 20 for t in texts[:8])


def test_batches_are_balanced_by_bytes():
    assert m.n_bytes("abc") == 3 and m.n_bytes("é日😀") == 9
