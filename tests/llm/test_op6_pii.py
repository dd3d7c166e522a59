import hashlib
import random
import re

from tallymark.llm import op6_pii as m

RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    return [[(x.start(), x.end()) for x in re.finditer(p, text or "") if ok(x[0])] for _, p, ok in RULES]


def digest(spans):
    return ",".join(f"{RULES[k][0]}:{a}:{b}" for k, own in enumerate(spans) for a, b in own)


def rows_of_all_sorts():
    rng = random.Random(5)
    odd = [None, "", "a@b.com.c@d.e", "a@b.com_x@y.z a@b", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.0003.255", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (310) 555-4510, +12 +123 ++4915112345678", "a@b.de +49 30 123456 ", "😀 x@y.org 😀 10.0.0.1", "@@a@b..c", "a" * 3000 + "@x.y " + "b." * 2000, "9" * 5000, "1.1.1.1 " * 700, "x@y.z" * 300, "a\n+1 2\n3456789 0"]
    odd += ["".join(rng.choice("ab1.2@+- ()3.") for _ in range(rng.randrange(200))) for _ in range(150)]
    return odd


def test_base_spans_equal_brute_force(spark):
    rows = rows_of_all_sorts()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(rows)] + [(None, rows[8], 1, "x"), (8, rows[8], 1, "x")], "doc_id long, text string, email int, number string")
    got = m.find_personal_data(docs).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        want = brute(rows[8 if r.doc_id is None else r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(x) for x in want], rows[r.doc_id or 8]
        assert r.base_sha256 == hashlib.sha256(digest(want).encode()).hexdigest()
        assert set(digest(want).split(",")) - {""} <= set(r.spans.split(","))
    assert m.find_personal_data(docs.limit(0)).count() == 0


def counted(votes):
    seen = {}
    for v in votes:
        seen[v] = seen.get(v, 0) + 1
    return sorted(seen.items(), key=str)


def test_expectation_maximisation_finds_the_reliable_labeler():
    rng = random.Random(2)
    votes = []
    for _ in range(20000):
        y = rng.random() < 0.3
        votes.append(tuple((y if rng.random() < acc else not y) * 1 if rng.random() < 0.8 else None for acc in (0.95, 0.9, 0.6)))
    rates, _, share = m.em_reliabilities(counted(votes))
    right = [r[0][1] / (r[0][0] + r[0][1]) for r in rates]
    assert [abs(a - b) < 0.05 for a, b in zip(right, (0.95, 0.9, 0.6), strict=True)] == [True] * 3
    assert abs(share - 0.3) < 0.03
    assert m.em_reliabilities([])[1] == []


def test_a_labeler_that_is_always_wrong_comes_out_as_bad():
    rng = random.Random(7)
    votes = []
    for i in range(1000):
        y = i % 2
        votes.append((y if rng.random() < 0.9 else None, y if rng.random() < 0.8 else None, 1 - y))
    rates, posts, share = m.em_reliabilities(counted(votes))
    wrong = rates[2]
    assert wrong[0][1] < 0.05 < 0.9 < wrong[1][1] and wrong[0][0] > 0.9 > 0.05 > wrong[1][0]
    assert abs(share - 0.5) < 0.05
    assert all((p > 0.9) == (v[2] == 0) for (v, _), p in zip(counted(votes), posts, strict=True))


def test_reliabilities_do_not_depend_on_the_number_of_spans():
    patterns = [((1, 1), 77), ((1, None), 84)]
    for times in (1, 1000):
        assert min(m.em_reliabilities([(v, c * times) for v, c in patterns])[1]) > 0.99


def planted(rng):
    """Texts with one marked span of personal data each, and texts with none, in about equal numbers."""
    word = lambda: "".join(rng.choices("etaoinshrdlu", k=rng.randrange(3, 8)))
    fill = lambda n: " ".join(word() for _ in range(n))
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    name = lambda: f"{rng.choice(m.FIRST_NAMES)} {word().capitalize()}"
    unlisted = lambda: f"{word().capitalize()} {word().capitalize()}"
    card = lambda: next(d for d in iter(lambda: digits(16), None) if not luhn(d))
    good = [
        ("number", "please call ", lambda: f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{digits(4)}"), ("number", "ssn ", lambda: f"{digits(3)}-{digits(2)}-{digits(4)}"), ("number", "card ", card),
        ("name", "Dear ", lambda: word().capitalize()), ("name", "regards, ", name), ("name", "kind regards, ", unlisted), ("name", "patient ", unlisted), ("name", "met Dr. ", lambda: word().capitalize()), ("address", "lives at ", lambda: f"{rng.randrange(1, 300)} {word().capitalize()} Street"), ("address", "in der ", lambda: f"{word().capitalize()}straße {rng.randrange(1, 99)}"),
        ("id", "iban ", lambda: f"DE{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}"), ("mail", "write to ", lambda: f"{word()} (at) {word()} (dot) com"), ("mail", "mail ", lambda: f"{word()}.{word()} at {word()} dot org"),
    ]
    bad = [lambda: f"the total {digits(9)} was", lambda: f"on 2024-0{rng.randrange(1, 9)}-1{rng.randrange(9)} it", lambda: f"the {word().capitalize()} {word().capitalize()} Museum", lambda: f"part {rng.choice('ABC')}{digits(6)} was", lambda: f"order {digits(10)} of", lambda: f"at {word().capitalize()} {word().capitalize()}", lambda: f"isbn {digits(13)} in"]
    rows, truth = [], {}
    for i in range(60 * len(good)):
        kind, lead, make = good[i % len(good)]
        start = f"{fill(9)} {lead}"
        value = make()
        truth[len(rows)] = (kind, len(start), len(start) + len(value))
        rows.append(f"{start}{value} {fill(9)}")
    rows += [f"{fill(9)} {bad[i % len(bad)]()} {fill(9)}" for i in range(600)]
    return rows, truth


def test_precision_and_recall_on_planted_rows(spark):
    rows, truth = planted(random.Random(4))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    hits = {k: [0, 0] for k in m.FOUND}
    wrong = 0
    for r in m.find_personal_data(docs).collect():
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if k in m.FOUND]
        if r.doc_id in truth:
            kind = truth[r.doc_id][0]
            hits[kind][1] += 1
            hits[kind][0] += any(a <= truth[r.doc_id][1] and b >= truth[r.doc_id][2] for _, a, b in spans)
        else:
            wrong += len(spans)
    assert wrong <= 30, wrong  # of 600 texts
    assert all(h >= 0.9 * n for h, n in hits.values()), hits


def test_adds_numbers_on_the_test_tables(spark):
    """Sixteen digits that fail the check digit, or stand in a longer run that the base drops, are no base spans: all are found, and no other numbers."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = dict(map(tuple, docs.collect()))
    got = {r.doc_id: r for r in m.find_personal_data(docs).collect()}
    numbers = {(i, x.start(), x.end()) for i, t in texts.items() for x in re.finditer(r"(?<![0-9A-Za-z.,+-])[0-9]{16}(?![0-9A-Za-z])", t) if not any(a < x.end() and x.start() < b for own in brute(t) for a, b in own)}
    found = {(i, int(a), int(b)) for i, r in got.items() for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if k == "number"}
    assert numbers and found == numbers, [(texts[i][a - 30 : b + 30], (i, a, b) in found) for i, a, b in found ^ numbers]


def test_very_long_text(spark):
    text = "Dear Maria, call (212) 555-0199 now. " * 20_000 + "x" * 200_000 + " A" * 100_000
    r = m.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.n_number + r.n_name >= 20_000 and r.n_email == 0


def test_query_is_native_and_matches_brute_force(spark, small):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    df = m.op6_pii(spark, small)
    for r in df.collect():
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(digest(want).encode()).hexdigest()
