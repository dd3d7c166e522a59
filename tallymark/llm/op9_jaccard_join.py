"""Near duplicates by the Jaccard similarity of their word shingles, exactly.

1. Every text becomes the set of its distinct k-word shingles. Equal sets form a class; only the
   class's smallest id goes on, so copies cost nothing further.
2. Texts are hashed into blocks; each block sends its shingles, counted and packed, to shards, which
   answer with those found in two classes or more. A text whose rarest shingles are its own alone
   can't reach the threshold with any other, so most texts end here (prefix filter, rarest first).
3. What is left meets in size-banded tiles: one for each shared prefix shingle and band of set
   sizes, with the next band as guests. Every text first goes to its largest tile alone. Of the others,
   only tiles that hold more than one of the components found by then are looked into, those
   with the same members once. Large tiles are dealt into parts, so that no task gets an unbounded group.
4. In a tile, the bit count of two hashed bitmaps' difference bounds the overlap from above. Only
   members with a pair that passes send their sets, to be intersected exactly as sorted arrays. Pairs
   that are connected already are skipped, so a tile gives fewer links than it has members, not all
   pairs. Texts that pass in many tiles send their sets to the fullest one first; where that leaves
   components apart, wider bitmaps must pass too.
5. Links between classes are closed to components by star steps.

Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import block_count, bounded_batches, column, corpus_bytes, hash_words, split_words, table, window_hashes, written
from tallymark.llm.components import connected_components

#: Members of a tile, or of one of its parts, that one task compares with each other.
PART = 1024
#: Bits of the bitmaps that are compared before sets are sent.
SIGNATURE = 4096
#: Most bits of the wider ones, which have eight or more for each shingle up to here.
WIDE_SIGNATURE = 1 << 16
_LOW = np.uint64(0xFFFFFFFF)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text its distinct k-word shingles as sorted 64-bit hashes; of fewer words, all of them as one."""
    index, offsets, words = split_words(texts)
    h = hash_words(words)[index] if len(index) else np.empty(0, np.uint64)
    windows, at = window_hashes(h, offsets, k)
    cut = np.searchsorted(at, offsets)
    for i in range(len(offsets) - 1):
        if n := offsets[i + 1] - offsets[i]:
            if n < k:
                yield np.array([xxhash.xxh3_64_intdigest(h[offsets[i] : offsets[i + 1]].tobytes(), seed=int(n))], np.uint64)
            else:
                s = np.sort(windows[cut[i] : cut[i + 1]])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        else:
            yield np.empty(0, np.uint64)


def _profiles(batches, k: int):
    for batch in batches:
        sets = list(shingle_sets(column(batch, "text"), k))
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())], names=["doc_id", "n_shingles", "set_hash"])


def _class_sets(rows: pa.Table, ids: list, hashes: list, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Id and set of the one row that stands for each of the classes given by smallest id and hash of set."""
    wanted = set(zip(ids, hashes, strict=True))
    held = {i for i, _ in wanted}
    doc_ids = column(rows, "doc_id").to_pylist()
    at = [j for j, i in enumerate(doc_ids) if i in held]
    for j, s in zip(at, shingle_sets(column(rows, "text").take(pa.array(at, pa.int64())), k), strict=True):
        key = (doc_ids[j], xxhash.xxh3_128_digest(s.tobytes()))
        if key in wanted:
            wanted.discard(key)
            yield doc_ids[j], s


def _keys(s: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard in the upper half, the hash's lower half below."""
    return (((s >> np.uint64(32)) % np.uint64(n_shards)) << np.uint64(32)) | (s & _LOW)


def _counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(weights, first)


def _asked(rows: pa.Table, reps: pa.Table, block: int, k: int, n_shards: int) -> pa.Table:
    sets = [_keys(s, n_shards) for _, s in _class_sets(rows, column(reps, "doc_id").to_pylist(), column(reps, "set_hash").to_pylist(), k)]
    keys, counts = _counted(np.concatenate(sets or [np.empty(0, np.uint64)]))
    shard = (keys >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.diff(shard, prepend=-1, append=-1)) if len(keys) else np.zeros(1, int)
    out = [(int(shard[a]), block, (keys[a:b] & _LOW).astype(np.uint32).tobytes(), counts[a:b].astype(np.uint32).tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["shard", "block", "keys", "counts"])


def _shared(rows):
    """For each block that asked, those of its shingles that more than one class has, and how many."""
    keys = [np.frombuffer(x, np.uint32) for x in column(rows, "keys").to_pylist()]
    all_keys, totals = _counted(np.concatenate(keys), np.concatenate([np.frombuffer(x, np.uint32) for x in column(rows, "counts").to_pylist()]).astype(np.int64))
    all_keys, totals = all_keys[totals > 1], totals[totals > 1]
    kept = []
    for x in keys:
        at = np.searchsorted(all_keys, x)
        hit = np.flatnonzero(at < len(all_keys))
        hit = hit[all_keys[at[hit]] == x[hit]]
        kept.append((x[hit].tobytes(), np.minimum(totals[at[hit]], 2**32 - 1).astype(np.uint32).tobytes()))
    return pa.table({"block": column(rows, "block"), "shard": column(rows, "shard"), "keys": pa.array([x[0] for x in kept], pa.binary()), "counts": pa.array([x[1] for x in kept], pa.binary())})


def _prefixes(rows: pa.Table, told: pa.Table, k: int, percent: int, n_shards: int) -> pa.Table:
    shard, ids, hashes, keys, counts = (column(told, c).to_pylist() for c in ("shard", "doc_id", "set_hash", "keys", "counts"))
    answers = sorted((s, x, c) for s, x, c in zip(shard, keys, counts, strict=True) if s is not None)
    known = np.concatenate([(np.uint64(s) << np.uint64(32)) | np.frombuffer(x, np.uint32).astype(np.uint64) for s, x, _ in answers] or [np.empty(0, np.uint64)])
    found_in = np.concatenate([np.frombuffer(c, np.uint32) for *_, c in answers] or [np.empty(0, np.uint32)])
    out: list[tuple] = []
    reps = [(i, x) for s, i, x in zip(shard, ids, hashes, strict=True) if s is None]
    if not len(known):
        reps = []
    for i, s in _class_sets(rows, [x[0] for x in reps], [x[1] for x in reps], k):
        key = _keys(s, n_shards)
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        hit = known[at] == key
        shared, n = s[hit], len(s)
        own, prefix = n - len(shared), n - -(-percent * n // 100) + 1
        if own < prefix:
            rare = np.lexsort((shared, found_in[at[hit]]))[: prefix - own]
            if len(rare):
                out.append((i, n, shared[rare].astype(np.int64).tolist(), shared.tobytes(), len(shared), signature(shared, SIGNATURE), signature(shared, wide_bits(n))))
    return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.binary(), pa.binary()))], names=["id", "n", "keys", "shared", "size", "signature", "wide"])


def tile_links(ids: np.ndarray, n: np.ndarray, home: np.ndarray, part: np.ndarray | None, sets: list[np.ndarray], percent: int, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect whatever the tile's members at ``percent`` or more connect, and no more than that.

    Members of one ``group`` are connected already. ``n`` are whole set sizes, ``sets`` the sorted shingles that some other text has too. Two guests
    are left to their own tile, and with ``part`` two members of one part to the task that has it.
    """
    order = np.argsort(n, kind="stable")
    ids, n, home, sets = ids[order], n[order], home[order], [sets[i] for i in order]
    part = part[order] if part is not None else None
    group = np.arange(len(ids)) if group is None else group[order].copy()
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    start = np.concatenate([[0], np.cumsum(size)])
    bits = np.zeros((len(ids), 1024), bool)
    bits[np.repeat(np.arange(len(ids)), size), (flat >> np.uint64(54)).astype(np.int64)] = True
    bitmap = np.packbits(bits, axis=1).view(np.uint64)
    _, flat = np.unique(flat, return_inverse=True)
    mark = np.zeros(int(flat.max(initial=-1)) + 1, bool)
    links = []
    for i in range(1, len(ids)):
        ok = (100 * n[:i] >= percent * n[i]) & (group[:i] != group[i]) & (home[:i] | home[i])
        if part is not None:
            ok &= part[:i] != part[i]
        near = np.flatnonzero(ok)
        apart = np.bitwise_count(bitmap[near] ^ bitmap[i]).sum(1, dtype=np.int64)
        most = (size[near] + size[i] - apart) // 2
        near = near[100 * most >= percent * (n[near] + n[i] - most)]
        mark[flat[start[i] : start[i + 1]]] = True
        while len(near):
            some, near = near[:64], near[64:]
            common = [int(mark[flat[start[j] : start[j + 1]]].sum()) for j in some]
            for j, c in zip(some, common, strict=True):
                if group[j] != group[i] and 100 * c >= percent * (n[j] + n[i] - c):
                    links.append((int(ids[j]), int(ids[i])))
                    group[group == group[j]] = group[i]
            near = near[group[near] != group[i]]
        mark[flat[start[i] : start[i + 1]]] = False
    return links


def signature(s: np.ndarray, n_bits: int) -> bytes:
    """The hashed bitmap of a set; ``n_bits`` is a power of two."""
    bits = np.zeros(n_bits, bool)
    bits[(s & np.uint64(n_bits - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def wide_bits(n: int) -> int:
    return min(WIDE_SIGNATURE, max(SIGNATURE, 1 << (8 * n - 1).bit_length()))


def folded(signatures: list[bytes]) -> np.ndarray:
    """One row of 64-bit words for each bitmap, all as long as the shortest; bits that meet are joined."""
    n = min(map(len, signatures)) // 8
    return np.stack([np.bitwise_or.reduce(np.frombuffer(x, np.uint64).reshape(-1, n)) for x in signatures])


def _promising(rows, percent: int):
    """Members of tiles (or pairs of parts) that some other member may reach, going by sizes and bit counts alone."""
    key, band, low, high, part = (np.asarray(column(rows, c)) for c in ("key", "band", "low", "high", "part"))
    ids, n, home, group, size = (np.asarray(column(rows, c)) for c in ("id", "n", "home", "component_id", "size"))
    signatures = column(rows, "signature").to_pylist()
    order = np.lexsort((n, high, low, band, key))
    same = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (key, band, low, high)])
    hit = np.zeros(len(ids), bool)
    for at in np.split(order, np.flatnonzero(~same) + 1):
        bitmap = folded([signatures[i] for i in at])
        for x in range(1, len(at)):
            i, near = at[x], at[:x]
            ok = (100 * n[near] >= percent * n[i]) & (group[near] != group[i]) & (home[near] | home[i])
            if low[i] != high[i]:
                ok &= part[near] != part[i]
            near = near[ok]
            most = (size[near] + size[i] - np.bitwise_count(bitmap[:x][ok] ^ bitmap[x]).sum(1, dtype=np.int64)) // 2
            near = near[100 * most >= percent * (n[near] + n[i] - most)]
            if len(near):
                hit[near] = hit[i] = True
    return rows.select(["id", "n", "key", "band", "home", "component_id", "part", "low", "high", "bucket"]).filter(pa.array(hit))


def _linked(rows, percent: int):
    key, band, low, high, part = (np.asarray(column(rows, c)) for c in ("key", "band", "low", "high", "part"))
    ids, n, home, group = (np.asarray(column(rows, c)) for c in ("id", "n", "home", "component_id"))
    sets = [np.frombuffer(x, np.uint64) for x in column(rows, "shared").to_pylist()]
    order = np.lexsort((high, low, band, key))
    same = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (key, band, low, high)])
    links: set[tuple[int, int]] = set()
    for at in np.split(order, np.flatnonzero(~same) + 1):
        if len(at) > 1:
            links.update(tile_links(ids[at], n[at], home[at], None if low[at[0]] == high[at[0]] else part[at], [sets[i] for i in at], percent, group[at]))
    return pa.table([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, block_bytes: int = 8 << 20) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row of ``docs(doc_id, text)``.

    Two texts link when 100 * |intersection| >= percent * |union| of their shingle sets;
    ``component_id`` is the smallest id that links reach. Null and empty texts have no shingles and
    link with nothing, not even each other. Rows with one id count as one document. A row without id
    gets the component of texts with the same set, else null, and links nothing further.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = block_count(corpus_bytes(rows), block_bytes)
    found = written(rows.mapInArrow(lambda b: _profiles(b, words), "doc_id long, n_shingles long, set_hash binary"))
    classes = written(found.where("n_shingles > 0").groupBy("set_hash").agg(F.min("doc_id").alias("rep")))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(n)).alias("block")
    # A class is named by an id, so rows without one have nothing to send.
    blocks = rows.where("doc_id is not null").select("*", block)
    reps = classes.where("rep is not null").select(F.col("rep").alias("doc_id"), "set_hash").select("*", block)

    def asked(key, texts, of):
        return _asked(texts, of, key[0].as_py(), words, n)

    def prefixes(texts, told):
        return _prefixes(texts, told, words, percent, n)

    questions = blocks.groupBy("block").cogroup(reps.groupBy("block")).applyInArrow(asked, "shard long, block long, keys binary, counts binary")
    answers = questions.groupBy("shard").applyInArrow(_shared, "block long, shard long, keys binary, counts binary")
    messages = reps.unionByName(answers, allowMissingColumns=True)
    left = written(blocks.groupBy("block").cogroup(messages.groupBy("block")).applyInArrow(prefixes, "id long, n long, keys array<long>, shared binary, size long, signature binary, wide binary"))

    # A little wider than the threshold's ratio, so that rounding can't put linked sizes two bands apart.
    width = max(math.log(100 / percent), 1e-3) * 1.0001
    placed = left.select("id", "n", F.explode("keys").alias("key"), F.floor(F.log("n") / width).alias("own"))
    placed = placed.select("id", "n", "key", F.explode(F.array(F.struct(F.col("own").alias("band"), F.lit(True).alias("home")), F.struct((F.col("own") - 1).alias("band"), F.lit(False).alias("home")))).alias("x")).select("id", "n", "key", "x.*")
    placed = written(placed)
    sizes = placed.groupBy("key", "band").agg(F.count("*").alias("members"), F.count_if("home").alias("homes")).where("members > 1 and homes > 0")

    tile = ["key", "band", "low", "high"]
    dealt_columns = ["id", "n", "key", "band", "home", "component_id", "part", "low", "high", "bucket"]

    def dealt(rows: DataFrame) -> DataFrame:
        """Rows of tiles dealt into pairs of parts: ``rows(key, band, members, id, n, home, component_id)``."""
        parts = F.ceil(F.col("members") / PART)
        out = rows.select("id", "n", "key", "band", "home", "component_id", F.pmod(F.xxhash64("id", F.lit(7)), parts).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("other"))
        out = out.select("id", "n", "key", "band", "home", "component_id", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
        return out.withColumn("bucket", F.pmod(F.xxhash64(*tile), F.lit(4 * n))).select(dealt_columns)

    def promising(rows: DataFrame, bitmap: str) -> DataFrame:
        signed = rows.join(left.select("id", "n", "size", F.col(bitmap).alias("signature")), ["id", "n"])
        return written(signed.groupBy("bucket").applyInArrow(lambda rows: _promising(rows, percent), rows.schema))

    def linked(rows: DataFrame) -> DataFrame:
        sets = rows.join(left.select("id", "n", "shared"), ["id", "n"])
        return written(sets.groupBy("bucket").applyInArrow(lambda rows: _linked(rows, percent), "a long, b long"))

    def told(rows: DataFrame, joined: DataFrame) -> DataFrame:
        return rows.join(joined, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))

    def any_row(rows: DataFrame) -> bool:
        return bool(rows.limit(1).count())

    largest = placed.join(sizes, ["key", "band"]).groupBy("id", "n").agg(F.max(F.struct("members", "key", "band", "home")).alias("t")).select("id", "n", "t.*", F.col("id").alias("component_id"))
    links = linked(promising(dealt(largest), "signature"))
    joined = written(connected_components(links))

    rows = told(placed, joined)
    several = rows.groupBy("key", "band").agg(F.count("*").alias("members"), F.count_if("home").alias("homes"), F.bit_xor(F.xxhash64("id", "home")).alias("x"), F.bit_xor(F.xxhash64("home", "id", "n")).alias("y"), F.min("component_id").alias("low"), F.max("component_id").alias("high"))
    several = several.where("homes > 0 and low <> high").groupBy("members", "x", "y").agg(F.min(F.struct("key", "band")).alias("tile")).select("tile.*", "members")
    passed = promising(dealt(rows.join(several, ["key", "band"])), "signature")
    if any_row(passed):
        fullest = passed.join(passed.groupBy(tile).agg(F.count("*").alias("members")), tile)
        fullest = fullest.groupBy("id", "n").agg(F.max(F.struct("members", *tile, "home", "component_id", "part", "bucket")).alias("t")).select("id", "n", "t.*")
        links = links.unionByName(linked(fullest.select(dealt_columns)))
        joined = written(connected_components(links))
        apart = told(passed.drop("component_id"), joined)
        apart = apart.join(apart.groupBy(tile).agg(F.min("component_id").alias("a"), F.max("component_id").alias("b")).where("a <> b").select(tile), tile)
        passed = promising(apart.select(dealt_columns), "wide")
        if any_row(passed):
            links = links.unionByName(linked(passed))
            joined = connected_components(links)
    named = classes.join(joined, classes["rep"] == joined["id"], "left").select("set_hash", F.coalesce("component_id", "rep").alias("component_id"))
    return found.join(named, "set_hash", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=90)


ORACLE_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), shingles as (
  select distinct doc_id, case when len(w) < 3 then array_to_string(w, ' ') else array_to_string(w[i:i + 2], ' ') end as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from words where len(w) > 0)
), sizes as (
  select doc_id, count(*) as n from shingles group by doc_id
), links as (
  select a.doc_id as a, b.doc_id as b
  from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id
  join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 90 * (x.n + y.n - count(*))
), reach as (
  select doc_id as a, doc_id as b from documents
  union
  select r.a, l.b from reach r join links l on l.a = r.b
)
select d.doc_id, coalesce(s.n, 0) as n_shingles, c.component_id
from documents d left join sizes s using (doc_id)
join (select a, min(b) as component_id from reach group by a) c on c.a = d.doc_id
"""
