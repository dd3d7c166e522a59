import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tallymark.llm import op12_source_divergence as m

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=10, top=10):
    docs = [(l or "", s or "", TERM.findall((t or "").translate(UPPER))) for t, l, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df, counts = Counter(), defaultdict(Counter)
        for l, s, terms in docs:
            if l == lang:
                df.update(set(terms))
                counts[s].update(terms)
        kept = [t for t, n in df.items() if n >= least]
        v = len(kept)
        total = {s: sum(c[t] for t in kept) for s, c in counts.items()}
        all_ = sum(total.values())
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (total[s] + 2 * v) for t in kept} for s, c in counts.items()}
        q = {t: 1 + 10**9 * (sum(c[t] for c in counts.values()) + 2) // (all_ + 2 * v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in counts.items():
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if c[t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, i, x, r) for r, (i, x) in enumerate(ranked, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def made(n=400, seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "grüße", "Grüße", "日本", "a1b", "x" * 300, "zz", "über", " ", "é", "é", "tie", "tied", "ties", "t"]
    out = []
    for _ in range(n):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", "ü", None])
        out.append((" ".join(rng.choices(words, weights=[1 + (hash(source or "") + i) % 5 for i in range(len(words))], k=rng.randrange(0, 30))) if rng.random() > 0.05 else None, lang, source))
    out += [("", "fr", "alone"), (None, "fr", "other"), ("12 34", "es", "s1")]  # languages without kept terms
    out += [("same same text", "en", "s1")] * 30
    out.append(("word " * 200_000, "en", "s2"))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string")


def test_equals_brute_force(spark):
    rows = made()
    want = brute(rows)
    assert rows_of(m.divergence(frame(spark, rows))) == want
    assert any(r[2] == "term" for r in want) and any(r[4] == 0 for r in want)


def test_blocks_of_sources_and_small_tries_change_nothing(spark):
    rows = made(seed=2) + [(f"w{i % 7} common", "en", f"src{i % 23}") for i in range(300)]
    want = rows_of(m.divergence(frame(spark, rows)))
    assert want == brute(rows)
    assert rows_of(m.divergence(frame(spark, rows).repartition(7), block=3, ranges=9, strip=3, chunk=2)) == want


def test_empty_and_clashing_columns(spark):
    assert m.divergence(frame(spark, [])).count() == 0
    rows = made(60)
    more = frame(spark, rows).selectExpr("*", "1 as term", "map(1, 2) as value", "'x' as item", "'y' as part", "2 as rank")
    assert rows_of(m.divergence(more)) == brute(rows)


def test_exact_for_counts_of_any_size():
    big = np.array([0, 5, 10**10, 4 * 10**17], np.int64)
    n, v = int(big.sum()), 4
    assert m.shares(big, n, v).tolist() == [1 + 10**9 * (int(c) + 2) // (n + 2 * v) for c in big]


def test_tries_are_cut_and_merged_without_loss():
    rng = random.Random(5)
    tries, want = [], defaultdict(Counter)
    for k in range(4):
        terms = sorted({"".join(rng.choices("abäß日😀", k=rng.choice([1, 2, 3, 60]))).encode() for _ in range(300)})
        sources = [f"s{k}", "all"]
        leaf, source, n = (np.array(x) for x in zip(*[(i, rng.randrange(2), rng.randrange(1, 300)) for i in range(len(terms)) for _ in range(2)]))
        for i, s, c in zip(leaf.tolist(), source.tolist(), n.tolist()):
            want[terms[i]][sources[s]] += c
        tries.append(m.RadixTrie.grown(pa.array(terms, pa.large_binary()), leaf, source, n, np.ones(len(leaf), np.int64), sources))
    pieces = [m.RadixTrie.of_row(part.row("xx", r)) for t in tries for r, part in t.cut([b"aa", "ä".encode(), "日b".encode()])]
    t = m.RadixTrie.merged(pieces)
    got = [(term, {t.sources[t.source[c]]: int(t.n[c]) for c in range(t.first[i], t.first[i + 1])}) for i, term in enumerate(t.terms.to_pylist())]
    assert got == sorted((k, dict(v)) for k, v in want.items()) and int(t.docs.sum()) == sum(len(x.docs) for x in tries) * 2
