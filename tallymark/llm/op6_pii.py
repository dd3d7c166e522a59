"""Personal data by weak supervision, with DataFrame functions only.

Fixed patterns give the base spans. Candidates for more are strings of 7 to 19 digits, sequences of
capitalised words, street addresses, account and document numbers with letters, and e-mail addresses in
words. Labelers vote for or against each or not at all: patterns (shapes of telephone, card, register and
account numbers, dates), gazetteers (words that announce personal data or other things, titles and greetings, first
names, words of companies) and context (base spans near by, brackets, units after, failed check digits). Votes are
counted by kind and pattern of votes, a table whose size depends on the number of labelers alone; expectation
maximisation (Dawid and Skene, not voting being an outcome too) estimates from it how reliable each labeler is for
each kind. The posteriors then train a naive Bayes classifier on the span's kind, shape, length, the word before
it and what is near by, which decides over candidates that some labeler voted for.

Match positions come from markers that a replacement puts around each match: the lengths of what lies
between markers add up to offsets. All of it happens within a row, without a shuffle of texts.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import table, written

BASE, FOUND = ("email", "ip", "card", "phone"), ("number", "name", "address", "id", "mail")
KINDS = BASE + FOUND
#: Marks around matches; what stands for these marks in texts; what hides base spans.
_OPEN, _CLOSE, _SEEN, _OTHER = "\ue000", "\ue001", "\ue003", "\ue002"
_LOCAL = "[A-Za-z0-9._%+-]"
#: Gazetteers: words before personal data, and before other things; titles and greetings; first names; words of organisations.
PERSONAL = ("account", "atentamente", "call", "card", "cell", "compte", "contact", "cordialement", "cuenta", "dob", "fax", "gruß", "grüße", "grüßen", "handy", "iban", "id", "insurance", "konto", "kontonummer", "mail", "mobil", "mobile", "name", "passport", "patient", "phone", "reach", "regards", "saludos", "signed", "sincerely", "ssn", "tel", "telefon", "telefono", "telephone", "teléfono", "téléphone", "whatsapp")
IMPERSONAL = ("article", "build", "chapter", "eur", "isbn", "issue", "line", "order", "page", "part", "population", "price", "seite", "serial", "total", "usd", "version", "vol", "year")
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Herrn", "Frau", "Sr", "Sra", "Señor", "Señora", "Monsieur", "Madame", "Mme", "Dear", "Hello", "Hallo", "Liebe", "Lieber", "Cher", "Chère", "Estimado", "Estimada", "Hola")
FIRST_NAMES = ("Alexander", "Ana", "Andrea", "Anna", "Antonio", "Camille", "Carlos", "Charlotte", "Christian", "Claudia", "Daniel", "David", "Elena", "Elizabeth", "Emma", "Felix", "François", "Hans", "Isabel", "James", "Jan", "Javier", "Jean", "John", "José", "Juan", "Julia", "Jürgen", "Karl", "Laura", "Léa", "Louis", "Lucas", "Luis", "Manuel", "Maria", "María", "Marie", "Martin", "Mary", "Michael", "Miguel", "Nicolas", "Patricia", "Paul", "Peter", "Pierre", "Robert", "Sabine", "Sarah", "Sophie", "Stefan", "Susanne", "Thomas", "William")
ORGANISATIONS = ("AG", "Association", "Bank", "Club", "Company", "Corp", "Foundation", "GmbH", "Inc", "Institute", "License", "Ltd", "Museum", "SA", "Society", "Union", "University", "Verein")
_WORD = r"\p{Lu}[\p{Ll}'’-]++"
_NAME = rf"(?<![\p{{L}}\p{{N}}]){_WORD}(?: {_WORD}){{1,3}}+(?![\p{{L}}\p{{N}}])|(?<=(?<![\p{{L}}\p{{N}}])(?:{'|'.join(TITLES)})\.? ){_WORD}(?![\p{{L}}\p{{N}}])"
_STREET = rf"(?<![\p{{L}}\p{{N}}])(?:[0-9]{{1,5}}[A-Za-z]? (?:{_WORD} ){{1,3}}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Drive|Boulevard|Blvd|Court|Way|Square|Place)(?!\p{{L}})|\p{{Lu}}[\p{{L}}-]++(?<=straße|strasse|weg|allee|platz|gasse) [0-9]{{1,4}}[a-z]?(?![\p{{L}}\p{{N}}])|(?:[0-9]{{1,5}},? )?(?:[Rr]ue|[Cc]alle|[Aa]venida|[Pp]laza) (?:(?:de|del|des|du|la|las|los) ){{0,2}}{_WORD}(?: [0-9]{{1,4}}(?![\p{{L}}\p{{N}}]))?)"
_ID = r"(?<![\p{L}\p{N}])(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3}+)?|[A-Z]{1,3}-?[0-9]{5,9}+)(?![\p{L}\p{N}])"
_MAIL = rf"(?<!{_LOCAL}){_LOCAL}++ ?(?:[\[({{] ?at ?[\])}}]| at (?=[A-Za-z0-9-]++ dot )) ?[A-Za-z0-9-]++(?: ?(?:[\[({{] ?dot ?[\])}}]|\.| dot ) ?[A-Za-z0-9-]++)++"
_NUMBER = r"(?<![0-9A-Za-z.,+-])(?:[0-9]{16}|\(?[0-9](?:[\x20()./-]{0,2}+[0-9]){6,18}+)(?![0-9A-Za-z])(?![.,-][0-9])"
#: The kinds' patterns, in forms that need no retries: a match begins where a run of its first
#: characters does, or right after the match before; what follows is taken without backtracking.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "found": f"{_MAIL}|{_STREET}|{_ID}|{_NAME}|{_NUMBER}",
}
#: What a text must have for a pattern to be tried at all.
_NEEDED = {"email": "@", "phone": "+"}
_PART = r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
LABELERS = ("shape", "other_shape", "announced", "other_word", "title", "first_name", "organisation", "bracket_or_plus", "unit_after", "check_digits", "near_personal")
#: Text around a candidate that context labelers see, and how far a base span may be; buckets of each feature; sums go in pieces of so many matches.
AROUND, NEAR, CLOSE_BY, BUCKETS, STRIDE = 24, 1000, 12, 256, 256
FEATURES = 4 + len(LABELERS)


def _pieces(text: Column, kind: str) -> Column:
    marked = F.split(F.regexp_replace(text, PATTERNS[kind], f"{_OPEN}$0{_CLOSE}"), _OPEN)
    return F.when(F.contains(text, F.lit(_NEEDED[kind])), marked).otherwise(F.array(text)) if kind in _NEEDED else marked


def with_spans(df: DataFrame, text: str, kinds: tuple[str, ...], around: bool = False) -> DataFrame:
    """Adds for each kind a column of all its matches, in code points: array of (start, end, value), with ``around`` also before and after, which go no further than over CLOSE_BY other matches."""
    df = df.select("*", *(_pieces(F.col(text), k).alias(f"_p_{k}") for k in kinds))
    lengths = [F.transform(f"_p_{k}", lambda p, i: F.length(p) - F.when(i > 0, 1).otherwise(0)).alias(f"_l_{k}") for k in kinds]
    df = df.select("*", *lengths)
    # Sums over strides, then over the strides before: no running sum ever copies an array.
    add = lambda a, x: a + x
    strides = lambda k: F.transform(F.sequence(F.lit(0), F.floor((F.size(f"_l_{k}") - 1) / STRIDE).cast("int")), lambda c: F.aggregate(F.slice(f"_l_{k}", c * STRIDE + 1, STRIDE), F.lit(0), add))
    df = df.select("*", *(strides(k).alias(f"_s_{k}") for k in kinds))
    befores = lambda k: F.transform(f"_s_{k}", lambda _, c: F.aggregate(F.slice(f"_s_{k}", 1, c), F.lit(0), add))
    df = df.select("*", *(befores(k).alias(f"_b_{k}") for k in kinds))

    def spans(k: str) -> Column:
        def span(i: Column) -> Column:
            c = F.floor(i / STRIDE).cast("int")
            start = F.element_at(f"_b_{k}", c + 1) + F.aggregate(F.slice(f"_l_{k}", c * STRIDE + 1, i - c * STRIDE), F.lit(0), add)
            piece = F.element_at(f"_p_{k}", i + 1)
            value = F.substring_index(piece, _CLOSE, 1)
            found = [start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value")]
            if around:
                plain = lambda at, n: F.replace(F.array_join(F.slice(f"_p_{k}", at, n), ""), F.lit(_CLOSE), F.lit(""))
                before = F.substring(plain(F.greatest(i - CLOSE_BY, F.lit(0)) + 1, F.least(i, F.lit(CLOSE_BY))), -NEAR, NEAR)
                after = F.substr(plain(i + 1, F.lit(CLOSE_BY)), F.length(value) + 1, F.lit(NEAR))
                found += [before.alias("before"), after.alias("after")]
            return F.struct(*found)

        return F.when(F.size(f"_p_{k}") > 1, F.transform(F.sequence(F.lit(1), F.size(f"_p_{k}") - 1), span)).otherwise(F.array().cast(f"array<struct<start:int,end:int,value:string{',before:string,after:string' if around else ''}>>"))

    return df.select(*[c for c in df.columns if c[:3] not in ("_p_", "_l_", "_s_", "_b_")], *(spans(k).alias(k) for k in kinds))


def masked(df: DataFrame, text: str, kinds: tuple[str, ...]) -> DataFrame:
    """The texts with every character of a base span replaced, kind by kind, so that no candidate overlaps one."""
    def hidden(valid):
        value, rest = lambda p: F.substring_index(p, _CLOSE, 1), lambda p: F.substring_index(p, _CLOSE, -1)
        return lambda p, i: F.when((i > 0) & valid(value(p)), F.concat(F.repeat(F.lit(_OTHER), F.length(value(p))), rest(p))).otherwise(F.replace(p, F.lit(_CLOSE), F.lit("")))

    for k in kinds:
        df = df.withColumn("_pieces", _pieces(F.col(text), k)).withColumn(text, F.array_join(F.transform("_pieces", hidden(_VALID[k])), "")).drop("_pieces")
    return df


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


#: By kind and value.
_VALID = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: F.forall(F.split(x, r"\."), lambda p: p.rlike(_PART)),
    "card": lambda x: F.length(_digits(x)).between(16, 19) & F.call_function("luhn_check", _digits(x)),
    "phone": lambda x: F.length(_digits(x)).between(8, 15),
}


def _kind_of(value: Column) -> Column:
    """Which of the kinds a candidate is, as its place in FOUND."""
    return F.when(~value.rlike(r"\p{L}"), 0).when(value.rlike(rf"^(?:{_MAIL})$"), 4).when(value.rlike(rf"^(?:{_STREET})$"), 2).when(value.rlike(rf"^(?:{_ID})$"), 3).otherwise(1)


def _votes(kind: Column, value: Column, before: Column, after: Column, near: Column) -> dict[str, Column]:
    """1 for, 0 against, null no vote; by the names in LABELERS."""
    word = F.regexp_extract(F.lower(before), r"([\p{L}]+)[\s:#.,=(+]*$", 1)
    digits = _digits(value)
    words = F.split(value, " ")
    any_of = lambda names: F.exists(words, lambda x: x.isin(*names))
    number, name = kind == 0, kind == 1
    telephone, register, card = r"\(?[0-9]{3}\)?[ ./-]{1,2}[0-9]{3}[ .-][0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{4}([ -]?[0-9]{4}){3}"
    date = r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}"
    return {
        "shape": F.when(number & value.rlike(rf"^(?:{telephone}|{register}|{card})$"), 1).when((kind == 3) & value.rlike("^[A-Z]{2}[0-9]{2}.{11}"), 1).when((kind == 2) | (kind == 4), 1),
        "other_shape": F.when(number & value.rlike(rf"^(?:{date}|[0-9]{{7,12}}$)"), 0).when((kind == 3) & value.rlike("^[A-Z]{1,3}-?[0-9]+$"), 0),
        "announced": F.when(word.isin(*PERSONAL), 1),
        "other_word": F.when(word.isin(*IMPERSONAL), 0),
        "title": F.when(name & (words[0].isin(*TITLES) | F.regexp_extract(before, r"(\p{L}+)\.? $", 1).isin(*TITLES)), 1),
        "first_name": F.when(name & any_of(FIRST_NAMES), 1),
        "organisation": F.when(name & (any_of(ORGANISATIONS) | F.regexp_extract(after, r"^ (\p{L}+)", 1).isin(*ORGANISATIONS)), 0),
        "bracket_or_plus": F.when(number & (value.startswith("(") | before.endswith("+")), 1),
        "unit_after": F.when(number & after.rlike(r"^\s?(?:%|€|\$ ?[0-9]|£|kg|km|mm|MB|GB|EUR|USD)"), 0),
        "check_digits": F.when(number & (F.length(digits) >= 13) & ~value.rlike(f"^{card}$") & ~F.call_function("luhn_check", digits), 0),
        "near_personal": F.when((number | (kind == 3)) & near, 1),
    }


def em_reliabilities(patterns: list[tuple[tuple, int]], rounds: int = 500, anchor: float = 10.0) -> tuple[list[list[list[float]]], list[float], float]:
    """Dawid and Skene for two classes on counted vote patterns; not voting is an outcome too.

    Gives each labeler's probabilities of outcomes (against, for, no vote) for true and for false spans, the
    posterior of every pattern, and the share of true spans. Starts from labelers that vote for every second true span
    and for one false one in fifty, and the other way round against, and from a share of one half; ``anchor`` pseudo-spans of each class keep
    them there when spans are few, and weigh nothing against many: a labeler that contradicts the others comes out as bad. Ends
    when the likelihood stands still.
    """
    n = len(patterns[0][0]) if patterns else 0
    start = [[0.02, 0.5, 0.48], [0.5, 0.02, 0.48]]
    rates = [[list(x) for x in start] for _ in range(n)]
    outcome = lambda v: 2 if v is None else v
    total = sum(c for _, c in patterns)
    posts, share, before = [], 0.5, -math.inf
    for _ in range(rounds if total else 0):
        posts, likelihood = [], anchor / 2 * math.log(share * (1 - share))
        likelihood += anchor * sum(s * math.log(r) for own in rates for y in (0, 1) for s, r in zip(start[y], own[y], strict=True))
        for votes, c in patterns:
            a = math.log(share) + sum(math.log(r[0][outcome(v)]) for v, r in zip(votes, rates, strict=True))
            b = math.log(1 - share) + sum(math.log(r[1][outcome(v)]) for v, r in zip(votes, rates, strict=True))
            both = max(a, b) + math.log1p(math.exp(-abs(a - b)))
            posts.append(math.exp(a - both))
            likelihood += c * both
        if likelihood - before <= 1e-9 * abs(likelihood):
            break
        before = likelihood
        share = (anchor / 2 + sum(c * p for p, (_, c) in zip(posts, patterns, strict=True))) / (anchor + total)
        for i in range(n):
            for y in (0, 1):
                sums = [anchor * x for x in start[y]]
                for p, (v, c) in zip(posts, patterns, strict=True):
                    sums[outcome(v[i])] += c * (1 - p if y else p)
                rates[i][y] = [x / sum(sums) for x in sums]
    return rates, posts, share


def _features(c: Column) -> Column:
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(c["value"], "[0-9]", "9"), r"\p{Ll}+", "a"), r"\p{Lu}", "A")
    word = F.regexp_extract(F.lower(c["before"]), r"([\p{L}]+)[^\p{L}]*$", 1)
    bucket = lambda x: (c["kind"] * BUCKETS + F.pmod(F.xxhash64(x), F.lit(BUCKETS))).cast("int")
    votes = F.transform(c["votes"], lambda v: (c["kind"] * BUCKETS + F.coalesce(v, F.lit(2))).cast("int"))
    return F.concat(F.array((c["kind"] * BUCKETS).cast("int"), bucket(shape), bucket(word), bucket(F.length(c["value"]))), votes)


def train(found: DataFrame) -> list[list[float]]:
    """Log-odds of the classifier, a weight by feature and bucket, from ``found(candidates)``.

    Two tables reach the driver: counts by kind and vote pattern (at most 3 ** labelers each) and sums by bucket.
    """
    each = found.select(F.explode("candidates").alias("c")).select("c.kind", "c.votes", "c.features")
    counted = sorted(((r[0], tuple(r[1]), r[2]) for r in each.groupBy("kind", "votes").count().collect()), key=str)
    weights = [[0.0] * BUCKETS * len(FOUND) for _ in range(FEATURES)]
    if not counted:
        return weights
    told = []
    for kind in sorted({k for k, *_ in counted}):
        own = [(v, n) for k, v, n in counted if k == kind]
        voting = [i for i in range(len(LABELERS)) if any(v[i] is not None for v, _ in own)]
        posts = em_reliabilities([(tuple(v[i] for i in voting), n) for v, n in own])[1]
        told += [(kind, list(v), p) for (v, _), p in zip(own, posts, strict=True)]
    key = F.concat_ws(",", "kind", F.transform("votes", lambda x: F.coalesce(x.cast("string"), F.lit("-")))).alias("k")
    # At most 3 ** labelers rows a kind, of which texts have far fewer; Spark broadcasts them if they are small.
    posteriors = written(found.sparkSession.createDataFrame(told, "kind int, votes array<int>, p double").select(key, "p"))
    sums = each.select(key, "features").join(posteriors, "k").select("p", F.posexplode("features").alias("feature", "bucket")).groupBy("feature", "bucket").agg(F.sum("p"), F.sum(1 - F.col("p"))).collect()
    # The first feature is the kind alone: its odds are the prior. What the others add is relative to it, and rare values add little.
    share = {b // BUCKETS: (y + 0.5) / (y + n + 1) for f, b, y, n in sums if f == 0}
    for f, b, y, n in sums:
        q = share[b // BUCKETS]
        weights[f][b] = math.log((y + q) / (n + 1 - q)) - math.log(q / (1 - q)) if f else math.log(q / (1 - q))
    return weights


def find_personal_data(docs: DataFrame, least: float = 0.9) -> DataFrame:
    """Counts, digest and spans of every row of ``docs(doc_id, text)``; other columns are ignored.

    ``spans`` has ``kind:start:end`` in code points, by kind as in KINDS and then by start; the kinds in FOUND are
    the method's: candidates that a labeler voted for, apart from all base spans, to which
    the classifier gives probability ``least`` or more. Null texts count as empty and have no spans. Repeated
    rows are judged alike. Texts are searched whole, however long. Nothing is learnt from an input without candidates, and nothing added.
    """
    clean = F.translate(F.coalesce("text", F.lit("")), _OPEN + _CLOSE + _OTHER, _SEEN * 3)
    valid = lambda k: lambda x: _VALID[k](x.value)
    rows = with_spans(docs.select("doc_id", clean.alias("text")), "text", BASE)
    rows = rows.select("doc_id", "text", *(F.transform(F.filter(k, valid(k)), lambda x: F.struct(x.start.alias("start"), x.end.alias("end"))).alias(k) for k in BASE))
    rows = with_spans(masked(rows, "text", BASE), "text", ("found",), around=True)
    rows = rows.withColumn("found", F.transform("found", lambda x: F.struct(_kind_of(x.value).alias("kind"), x.start.alias("start"), x.end.alias("end"), x.value.alias("value"), x.before.alias("before"), x.after.alias("after"))))

    def candidate(x: Column) -> Column:
        near = F.contains(x.before, F.lit(_OTHER)) | F.contains(x.after, F.lit(_OTHER))
        before, after = F.substring(x.before, -AROUND, AROUND), F.substring(x.after, 1, AROUND)
        votes = _votes(x.kind, x.value, before, after, near)
        return F.struct(x.kind.alias("kind"), x.start.alias("start"), x.end.alias("end"), x.value.alias("value"), before.alias("before"), F.array(*(votes[n].cast("int") for n in LABELERS)).alias("votes"))

    rows = rows.withColumn("found", F.transform("found", candidate))
    found = written(rows.select("doc_id", *BASE, F.transform("found", lambda c: F.struct(c.kind.alias("kind"), c.start.alias("start"), c.end.alias("end"), c.votes.alias("votes"), _features(c).alias("features"))).alias("candidates")))
    found = found.select("*", *(F.from_json(F.lit(json.dumps(w)), "array<double>").alias(f"_w{i}") for i, w in enumerate(train(found))))
    bar = math.log(least / (1 - least))

    def chosen(kind: int):
        return lambda c: (c["kind"] == kind) & F.exists(c["votes"], lambda v: v == 1) & (sum((F.element_at(f"_w{i}", c["features"][i] + 1) for i in range(FEATURES)), F.lit(0.0)) >= bar)

    text_of = lambda k: F.transform(k, lambda x: F.concat(F.lit(f"{k}:"), x.start.cast("string"), F.lit(":"), x.end.cast("string")))
    out = found.select("doc_id", *BASE, *(F.filter("candidates", chosen(i)).alias(k) for i, k in enumerate(FOUND)))
    counts = {k: F.size(k).cast("long").alias(f"n_{k}") for k in KINDS}
    base = F.array_join(F.concat(*map(text_of, BASE)), ",")
    return out.select("doc_id", *(counts[k] for k in BASE), F.sha2(base, 256).alias("base_sha256"), F.array_join(F.concat(*map(text_of, KINDS)), ",").alias("spans"), *(counts[k] for k in FOUND))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
