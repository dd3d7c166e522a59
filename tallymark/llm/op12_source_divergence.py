"""How far sources of a language differ in their words, from mergeable radix tries.

Each task counts the terms of its documents in byte tries, one a language, with a number of documents and counters by source in
each leaf. A trie is kept in preorder: a leaf is the number of bytes it shares with the leaf before (where its edge
branches off) and the rest of its label, so walking it gives terms in the order of UTF-8 bytes and merging needs no pointers. Tries are
cut at common bounds, and each prefix range's pieces are merged by one task. The bounds come from a bounded sample of terms and
decide who merges what, never what comes out. The merged, kept terms are walked in byte order for each pair of blocks of sources:
divergences of pairs are summed, and each group's best terms are kept, the first in byte order among equals.

Rows: null text, lang and source are ''; rows are documents, repeated ones too. A text without terms still makes its
(lang, source) group. A language without kept terms has pairs of value 0 and no terms. An empty table gives no rows. Memory
follows the longest text and a range's distinct terms.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import bounded_batches, column, table, written

#: Bytes that are no part of a term become spaces; A-Z become a-z.
_FOLD = bytes(c if c >= 128 else c | 32 if chr(c).isalpha() else 32 for c in range(256))
#: Shares are in billionths, with this much added to each count.
SCALE, ADDED = 1_000_000_000, 2
#: A leaf's edge branches off within so many bytes; what it shares beyond is spelt out.
DEEPEST = 32
#: Texts and terms looked at for the bounds of prefix ranges, and bytes of a bound.
SAMPLED_TEXTS, SAMPLED_TERMS, BOUND_BYTES = 2000, 100_000, 64
PIECE = "range int, lang string, shared binary, sizes binary, labels binary, docs binary, counters binary, source binary, n binary, sources array<string>"
LEAF = "lang string, term binary, docs long, sources array<string>, counts array<long>, part int"


def _packed(a: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest needs."""
    kind = np.min_scalar_type(int(a.max())) if len(a) else np.dtype(np.uint8)
    return bytes([kind.itemsize]) + a.astype(kind).tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.dtype(f"u{b[0]}"), offset=1).astype(np.int64)


def _sorted_codes(terms: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The distinct terms in the order of bytes, and each term's place among them."""
    coded = terms.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    order = pc.sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[np.asarray(order)] = np.arange(len(order))
    return place[np.asarray(coded.indices, dtype=np.int64)], coded.dictionary.take(order)


@dataclass
class RadixTrie:
    """Leaves in preorder: terms in the order of bytes, documents of each, and its counters, ``first[i]`` to ``first[i + 1]``."""

    terms: pa.Array
    docs: np.ndarray
    first: np.ndarray
    source: np.ndarray
    n: np.ndarray
    sources: list[str]

    @classmethod
    def grown(cls, terms: pa.Array, leaf: np.ndarray, source: np.ndarray, n: np.ndarray, docs: np.ndarray, sources: list[str]) -> RadixTrie:
        """From (leaf, source, occurrences, documents) in any order, ``leaf`` being a place in sorted ``terms``."""
        keys, at = np.unique(leaf * len(sources) + source, return_inverse=True)
        place, source = np.divmod(keys, max(1, len(sources)))
        used = np.unique(place)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, at, n)
        per_leaf = np.zeros(len(terms), np.int64)
        np.add.at(per_leaf, leaf, docs)
        return cls(terms.take(pa.array(used)), per_leaf[used], np.concatenate([np.searchsorted(place, used), [len(keys)]]), source, total, sources)

    @classmethod
    def merged(cls, tries: list[RadixTrie]) -> RadixTrie:
        if len(tries) == 1:
            return tries[0]
        names: dict[str, int] = {}
        source = np.concatenate([np.array([names.setdefault(s, len(names)) for s in t.sources], np.int64)[t.source] for t in tries])
        place, terms = _sorted_codes(pa.concat_arrays([t.terms for t in tries]))
        sizes = np.concatenate([np.diff(t.first) for t in tries])
        docs = np.zeros(int(sizes.sum()), np.int64)  # a leaf's documents go with its first counter
        docs[np.cumsum(sizes) - sizes] = np.concatenate([t.docs for t in tries])
        return cls.grown(terms, np.repeat(place, sizes), source, np.concatenate([t.n for t in tries]), docs, list(names))

    def part(self, a: int, z: int) -> RadixTrie:
        b, c = int(self.first[a]), int(self.first[z])
        return RadixTrie(self.terms.slice(a, z - a), self.docs[a:z], self.first[a : z + 1] - b, self.source[b:c], self.n[b:c], self.sources)

    def cut(self, bounds: list[bytes]) -> Iterator[tuple[int, RadixTrie]]:
        """Its prefix ranges: below the first bound, from each bound to the next, and from the last one on."""

        class Terms:
            __len__ = lambda _: len(self.terms)
            __getitem__ = lambda _, i: self.terms[i].as_py()

        ends = [0, *(bisect_left(Terms(), b) for b in bounds), len(self.terms)]
        yield from ((r, self.part(a, z)) for r, (a, z) in enumerate(zip(ends, ends[1:], strict=False)) if a < z)

    def row(self, lang: str, number: int) -> dict:
        offsets = np.frombuffer(self.terms.buffers()[1], np.int64)[self.terms.offset : self.terms.offset + len(self.terms) + 1]
        data = np.frombuffer(self.terms.buffers()[2], np.uint8)
        sizes = np.diff(offsets)
        at = np.minimum(offsets[:-1, None] + np.arange(DEEPEST), len(data) - 1)
        heads = np.where(np.arange(DEEPEST) < sizes[:, None], data[at], 0)
        shared = np.zeros(len(sizes), np.int64)
        shared[1:] = np.cumprod((heads[1:] == heads[:-1]) & (heads[1:] > 0), axis=1).sum(axis=1)
        spelt = np.ones(int(sizes.sum()), np.int64)  # where bytes that aren't shared lie
        begin, rest = offsets[:-1] + shared, sizes - shared
        rows = np.flatnonzero(rest)
        spelt = np.repeat(begin[rows] - np.concatenate([[0], np.cumsum(rest[rows])[:-1]]), rest[rows]) + np.arange(int(rest.sum()))
        used = np.unique(self.source)
        return {
            "range": number, "lang": lang, "shared": _packed(shared), "sizes": _packed(rest), "labels": data[spelt].tobytes(), "docs": _packed(self.docs), "counters": _packed(np.diff(self.first)),
            "source": _packed(np.searchsorted(used, self.source)), "n": _packed(self.n), "sources": [self.sources[i] for i in used.tolist()],
        }

    @classmethod
    def of_row(cls, r: dict) -> RadixTrie:
        path, terms, at, labels = b"", [], 0, r["labels"]
        for shared, size in zip(_unpacked(r["shared"]).tolist(), _unpacked(r["sizes"]).tolist(), strict=True):
            path = path[:shared] + labels[at : at + size]
            at += size
            terms.append(path)
        return cls(pa.array(terms, pa.large_binary()), _unpacked(r["docs"]), np.concatenate([[0], np.cumsum(_unpacked(r["counters"]))]), _unpacked(r["source"]), _unpacked(r["n"]), r["sources"])


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Terms of each text: place of every term among the distinct ones, the text it stands in, the distinct terms in byte order."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    folded = pa.py_buffer((data.to_pybytes() if data is not None else b"").translate(_FOLD))
    texts = pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, folded], offset=texts.offset)
    parts = pc.ascii_split_whitespace(texts)
    sizes = np.asarray(pc.list_value_length(parts))
    flat = parts.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    text = np.repeat(np.arange(len(texts)), sizes)[np.asarray(full)]
    place, terms = _sorted_codes(flat.filter(full).cast(pa.large_binary()))
    return place, text, terms


def gathered(batches: Iterator[pa.RecordBatch], most: int = 1 << 24) -> Iterator[pa.Table]:
    """Batches put together up to about so many bytes, so that a trie has many documents."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _numbered(values: pa.Array) -> tuple[np.ndarray, list[str]]:
    coded = values.dictionary_encode()
    return np.asarray(coded.indices, dtype=np.int64), coded.dictionary.to_pylist()


def _tries(bounds: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            (lang, langs), (source, sources) = (_numbered(column(b, c)) for c in ("lang", "source"))
            term, text, terms = terms_of(column(b, "text"))
            if not len(terms):
                continue
            pair, n = np.unique(text * len(terms) + term, return_counts=True)  # a document's term
            text, term = np.divmod(pair, len(terms))
            for i, name in enumerate(langs):
                own = np.flatnonzero(lang[text] == i)
                if len(own):
                    trie = RadixTrie.grown(terms, term[own], source[text[own]], n[own], np.ones(len(own), np.int64), sources)
                    yield pa.RecordBatch.from_pylist([part.row(name, r) for r, part in trie.cut(bounds)], schema=_PIECE)

    return run


_BINARY = ("shared", "sizes", "labels", "docs", "counters", "source", "n")
_PIECE = pa.schema([("range", pa.int32()), ("lang", pa.string()), *((c, pa.binary()) for c in _BINARY), ("sources", pa.list_(pa.string()))])


def _merged(least_docs: int, most_leaves: int):
    """Pieces of a range and language lie next to each other; they are merged whenever ``most_leaves`` have come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size = None, [], 0

        def kept() -> Iterator[pa.RecordBatch]:
            t = RadixTrie.merged(held)
            some = np.flatnonzero(t.docs >= least_docs)
            for a in range(0, len(some), 10_000):
                i = some[a : a + 10_000]
                sizes = t.first[i + 1] - t.first[i]
                at = np.repeat(t.first[i] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                names = pa.array(t.sources).take(pa.array(t.source[at]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key[1]] * len(i)), t.terms.take(pa.array(i)).cast(pa.binary()), pa.array(t.docs[i]), pa.ListArray.from_arrays(offsets, names), pa.ListArray.from_arrays(offsets, pa.array(t.n[at])), pa.array([key[0]] * len(i), pa.int32())],
                    names=["lang", "term", "docs", "sources", "counts", "part"],
                )

        for b in batches:
            for r in b.to_pylist():
                if (r["range"], r["lang"]) != key:
                    if held:
                        yield from kept()
                    key, held, size = (r["range"], r["lang"]), [], 0
                held.append(RadixTrie.of_row(r))
                size += len(held[-1].docs)
                if size > most_leaves and len(held) > 1:
                    held = [RadixTrie.merged(held)]
                    most = len(held[0].docs)
                    size = 0 if most > most_leaves // 2 else most  # a large trie is not merged again for every piece
        if held:
            yield from kept()

    return run


def range_bounds(rows: DataFrame, ranges: int) -> list[bytes]:
    """Bounds between so many prefix ranges with about as many of a sample's distinct terms in each."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            terms = pc.binary_slice(terms_of(column(b, "text"))[2].cast(pa.binary()), 0, BOUND_BYTES)
            yield pa.RecordBatch.from_arrays([terms.take(pa.array(np.arange(0, len(terms), max(1, -(-len(terms) // 1000)))))], names=["term"])

    sample = rows.select("text").limit(SAMPLED_TEXTS).mapInArrow(seen, "term binary").distinct().limit(SAMPLED_TERMS)
    terms = sorted(bytes(r.term) for r in sample.collect())
    return sorted({terms[len(terms) * i // ranges] for i in range(1, ranges)}) if terms else []


def term_counts(docs: DataFrame, least_docs: int, ranges: int | None = None, most_leaves: int = 1_000_000) -> DataFrame:
    """``(lang, term, docs, sources, counts, part)``: terms in at least so many of a language's documents; ``part`` is the prefix range."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    bounds = range_bounds(rows, ranges or int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = rows.mapInArrow(_tries(bounds), PIECE)
    dealt = pieces.repartition(len(bounds) + 1, "range").sortWithinPartitions("range", "lang")
    return written(dealt.mapInArrow(_merged(least_docs, most_leaves), LEAF))


def shares(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    """Smoothed shares in billionths, exact for counts of any size."""
    if counts.size and int(counts.max()) >= (1 << 62) // SCALE:
        counts = counts.astype(object)
    return (1 + SCALE * (counts + ADDED) // (n + ADDED * v)).astype(np.int64)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class _Tile:
    """The sources of two blocks of a language, and what its terms have added up to so far."""

    def __init__(self, header: dict, top: int):
        self.lang, self.names, self.n, self.v, self.lang_n, self.top = header["lang"], header["sources"], header["counts"], header["total"], header["lang_n"], top
        self.at = {s: i for i, s in enumerate(self.names)}
        self.mine = [i for i, r in enumerate(header["role"]) if r & 1]
        self.others = [i for i, r in enumerate(header["role"]) if r & 2]
        self.none = np.array([shares(np.zeros(1, np.int64), n, self.v)[0] if self.v else 0 for n in self.n], np.int64)
        self.pairs = np.zeros((len(self.mine), len(self.others)), np.int64)
        if self.v and not header["part"]:  # as if no term stood in any of these sources; each term puts right what it changes
            self.pairs += self.v * distance(self.none[self.mine][:, None], self.none[self.others][None, :])
        self.best: dict[int, list] = {i: [] for i in self.mine} if header["a"] == header["b"] else {}
        self.held: list[list] = []
        self.seen = 0

    def add(self, row: dict, chunk: int) -> None:
        if self.held and self.held[-1][0] == row["term"]:  # its counters in the other block
            self.held[-1][2] += row["sources"]
            self.held[-1][3] += row["counts"]
            return
        if len(self.held) >= chunk:
            self.take()
        self.held.append([row["term"], row["total"], row["sources"], row["counts"]])

    def take(self) -> None:
        if not self.held:
            return
        counts = np.zeros((len(self.held), len(self.names)), np.int64)
        for k, (_, _, sources, ns) in enumerate(self.held):
            counts[k, [self.at[s] for s in sources]] = ns
        p = np.stack([shares(counts[:, i], n, self.v) for i, n in enumerate(self.n)], axis=1)
        for k, i in enumerate(self.mine):
            self.pairs[k] += (distance(p[:, i : i + 1], p[:, self.others]) - distance(self.none[i], self.none[self.others])).sum(axis=0)
        if self.best:
            q = shares(np.array([x[1] for x in self.held], np.int64), self.lang_n, self.v)
            for i, best in self.best.items():
                f = distance(p[:, i], q)
                for k in np.flatnonzero((counts[:, i] > 0) & (p[:, i] > q)).tolist():
                    # terms come in ascending order, so among equal values those held came first and stay
                    if len(best) < self.top:
                        heapq.heappush(best, (int(f[k]), -self.seen - k, self.held[k][0]))
                    elif f[k] > best[0][0]:
                        heapq.heapreplace(best, (int(f[k]), -self.seen - k, self.held[k][0]))
        self.seen += len(self.held)
        self.held = []

    def batch(self) -> pa.RecordBatch:
        self.take()
        out = [(self.lang, self.names[i], "pair", self.names[j], int(self.pairs[k, m])) for k, i in enumerate(self.mine) for m, j in enumerate(self.others) if i != j]
        out += [(self.lang, self.names[i], "term", term.decode(), value) for i, best in self.best.items() for value, _, term in best]
        kinds = zip(("lang", "source", "part", "item", "value"), [pa.string()] * 4 + [pa.int64()], strict=True)
        return pa.RecordBatch.from_pylist([dict(zip(("lang", "source", "part", "item", "value"), r, strict=True)) for r in out], schema=pa.schema(list(kinds)))


def _compared(top: int, chunk: int):
    """A tile's header (without a term) comes first, then its terms in the order of bytes; where a language has no sources in a block there is no header and nothing to do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = of = None
        for b in batches:
            for r in b.to_pylist():
                key = (r["lang"], r["a"], r["b"], r["part"])
                if r["term"] is None:
                    if tile is not None:
                        yield tile.batch()
                    tile, of = _Tile(r, top), key
                elif tile is not None and key == of:
                    tile.add(r, chunk)
        if tile is not None:
            yield tile.batch()

    return run


def divergence(docs: DataFrame, least_docs: int = 10, top: int = 10, block: int = 256, ranges: int | None = None, strip: int = 50_000, chunk: int = 4096) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of ``docs(text, lang, source)``.

    ``pair``: every other source of the language with the summed divergence of all kept terms; ``term``: the source's ``top``
    terms above the language's share. Sources are compared in blocks of about ``block``, so a task holds the sums of one pair of blocks; with
    one block nothing is sent twice. Each pair of blocks is shared by tasks for neighbouring prefix ranges of about ``strip`` terms together.
    """
    kept = term_counts(docs, least_docs, ranges)
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
    each = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum(total).alias("lang_n"))
    groups = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = written(groups.join(each, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", zero("n"), zero("v"), zero("lang_n")))
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    n_blocks = max(1, -(-most // block))
    n_kept, last = kept.agg(F.count("*"), F.max("part")).first()
    strips = -(-n_kept // strip) or 1
    kept = kept.withColumn("part", F.expr(f"int(part * {strips} div {(last or 0) + 1})"))
    of = lambda source: F.pmod(F.xxhash64(source), F.lit(n_blocks)).cast("int")

    packs = groups.groupBy("lang", of("source").alias("a"), "v", "lang_n").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("s"))
    other = packs.select("lang", F.col("a").alias("b"), F.col("s").alias("s_b"))
    same = F.col("a") == F.col("b")
    sources = F.when(same, F.col("s")).otherwise(F.concat("s", "s_b"))
    role = F.when(same, F.transform("s", lambda x: F.lit(3))).otherwise(F.concat(F.transform("s", lambda x: F.lit(1)), F.transform("s_b", lambda x: F.lit(2))))
    heads = packs.join(other, "lang").withColumn("x", sources).select(
        "lang", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("part"), F.lit(None).cast("binary").alias("term"), F.col("v").alias("total"), F.col("x.source").alias("sources"), F.col("x.n").alias("counts"), role.alias("role"), "lang_n",
    )
    blocks = F.sequence(F.lit(0), F.lit(n_blocks - 1))
    mine = kept.select("lang", "part", "term", total.alias("total"), F.arrays_zip("sources", "counts").alias("x"), F.explode(blocks).alias("at"))
    mine = mine.withColumn("x", F.filter("x", lambda e: of(e.sources) == F.col("at"))).where(F.size("x") > 0)
    tiles = F.array_distinct(F.concat(F.transform(blocks, lambda o: F.struct(F.col("at").alias("a"), o.alias("b"))), F.transform(blocks, lambda o: F.struct(o.alias("a"), F.col("at").alias("b")))))
    rows = mine.withColumn("tile", F.explode(tiles)).select("lang", "tile.a", "tile.b", "part", "term", "total", F.col("x.sources").alias("sources"), F.col("x.counts").alias("counts"), F.lit(None).cast("array<int>").alias("role"), F.lit(None).cast("long").alias("lang_n"))
    tile = ["lang", "a", "b", "part"]
    found = heads.unionByName(rows).repartition(*tile).sortWithinPartitions(*tile, F.col("term").asc_nulls_first())
    found = written(found.mapInArrow(_compared(top, chunk), "lang string, source string, part string, item string, value long"))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank")
    best = found.where("part = 'term'").select("*", rank).where(F.col("rank") <= top)
    return pairs.select("*", rank).unionByName(best)


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
o as (select r, lang, source, unnest(w) as term from d),
k as (select lang, term from o group by all having count(distinct r) >= 10),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from o join k using (lang, term) group by all),
v as (select lang, count(*) as v from k group by all),
gn as (select lang, source, sum(n) as n from c group by all),
ln as (select lang, sum(n) as n from c group by all),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (coalesce(gn.n, 0) + 2 * v.v) as p
 from g join k using (lang) join v using (lang) left join c using (lang, source, term) left join gn using (lang, source)),
q as (select lang, term, 1 + (1000000000::hugeint * (sum(c.n) + 2)) // (any_value(ln.n) + 2 * any_value(v.v)) as q from c join ln using (lang) join v using (lang) group by lang, term),
pairs as (select a.lang, a.source, b.source as item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) as value
 from g a join g b on a.lang = b.lang and a.source <> b.source left join p x on x.lang = a.lang and x.source = a.source left join p y on y.lang = a.lang and y.source = b.source and y.term = x.term group by all),
terms as (select lang, source, term as item, (p - q) * (p - q) // (p + q) as value from p join q using (lang, term) where n > 0 and p > q)
select lang, source, 'pair' as part, item, coalesce(value, 0)::bigint as value, row_number() over (partition by lang, source order by coalesce(value, 0) desc, item)::int as rank from pairs
union all select * from (select lang, source, 'term' as part, item, value::bigint as value, row_number() over (partition by lang, source order by value desc, item)::int as rank from terms) where rank <= 10
"""
