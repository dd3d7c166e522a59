"""Conversations as a prefix trie: who shares which opening turns, and how many characters a shared prefix saves.

Level-synchronous. Going down, each level groups the live conversations by (parent node, next turn) and names
the new node by its smallest conv_id, so that (depth, conv_id) is a node's key. Going up, each level's
nodes are joined with the sums of their children, which gives leaves and savings.

What keeps levels small: equal conversations are one class (its smallest conv_id stands for it), and a node
with one class left is the head of a chain without branches, whose deeper nodes follow from running sums. Only nodes
that two different conversations share are met by a level, however long conversations are.

Rows: turns are ordered by ``turn``, null first, ties by the SHA-256 of role and text; repeated rows are turns of their own. Null
role or text is empty. Rows without conv_id belong to no conversation. An empty table gives no nodes, not even a root.
A turn is known by its SHA-256, a class by length and two 64-bit sums over its turns' hashes and places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import column, table, written

#: Ids in one piece of a class's list of members.
PIECE = 1 << 16
#: Of no members.
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def turn_key() -> Column:
    """A turn's identity: 32 bytes for its role and text, however long."""
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, position, key, chars, upto)``: turns by place in their conversation from 1, with characters up to and with each.

    Rows are dealt by ranges of (conversation, turn), so a conversation of any length is shared by many
    tasks; each range counts by itself, and only its first conversation, which may have begun in ranges
    before, needs an offset. There are as many offsets as ranges, so they are broadcast.
    """
    filled = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = filled.select("conv_id", "turn", turn_key().alias("key"), F.length("text").cast("long").alias("chars"))
    order = ["conv_id", "turn", "key"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at, upto = TaskContext.get().partitionId(), None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            ids, chars = np.asarray(column(b, "conv_id")), np.asarray(column(b, "chars"))
            new = np.concatenate([[ids[0] != last], ids[1:] != ids[:-1]])
            begin = np.maximum.accumulate(np.where(new, np.arange(len(ids)), -1))
            total = np.concatenate([[0], np.cumsum(chars)])
            goes_on = begin < 0  # the conversation of the batch before
            at_now = np.where(goes_on, at, -begin) + np.arange(len(ids)) + 1
            upto_now = total[1:] - np.where(goes_on, -upto, total[np.maximum(begin, 0)])
            last, at, upto = ids[-1], int(at_now[-1]), int(upto_now[-1])
            yield pa.RecordBatch.from_arrays([column(b, "conv_id"), column(b, "key"), column(b, "chars"), pa.array(at_now, pa.int64()), pa.array(upto_now, pa.int64()), pa.array(np.full(len(ids), part, np.int32))], names=["conv_id", "key", "chars", "at", "upto", "part"])

    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    each = written(ranged.mapInArrow(counted, "conv_id long, key binary, chars long, at long, upto long, part int"))
    firsts = each.groupBy("part").agg(F.min("conv_id").alias("conv_id"))
    again = each.join(F.broadcast(firsts.select("conv_id").distinct()), "conv_id").groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.sum("chars").alias("c"))
    before = again.alias("a").join(firsts.alias("f"), F.expr("a.conv_id = f.conv_id and a.part < f.part")).groupBy("f.part", "f.conv_id").agg(F.sum("n").alias("n0"), F.sum("c").alias("c0"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return each.join(F.broadcast(before), ["part", "conv_id"], "left").select("conv_id", (F.col("at") + zero("n0")).alias("position"), "key", "chars", (F.col("upto") + zero("c0")).alias("upto"))


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations and their turns for prefix_trie(), unchanged."""
    convs = turns.groupBy("conv_id").agg(F.sum("chars").alias("total"))
    return convs.select("conv_id"), turns.join(convs, "conv_id").select("conv_id", F.col("position").alias("depth"), "key", "chars", (F.col("total") - F.col("upto") + F.col("chars")).alias("rest"))


def with_shared_heads(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations and their turns, where each begins with the first h turns of its group's first id instead of its own; h is crc32(id) % ``most``.

    A head has less than ``most`` turns; it is one row for each id that is a multiple of ``group``, and goes to fewer than 2 * ``group`` ids.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    early = F.col("position") <= h
    convs = turns.groupBy("conv_id").agg(F.sum(F.when(early, F.col("chars")).otherwise(0)).alias("lost"), F.sum("chars").alias("total")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    of_base = turns.where((F.col("conv_id") % group == 0) & (F.col("position") < most)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("position", "key", "chars"))).alias("all"))
    convs = convs.join(of_base, "base", "left").withColumn("head", F.slice(F.coalesce("all", F.array().cast("array<struct<position:bigint,key:binary,chars:bigint>>")), F.lit(1), F.col("h")))
    chars = F.aggregate("head", F.lit(0).cast("long"), lambda s, x: s + x.chars)
    convs = written(convs.select("conv_id", "h", "lost", "head", F.size("head").alias("m"), chars.alias("gained"), (chars + F.col("total") - F.col("lost")).alias("length")))
    rest = F.col("length") - F.aggregate(F.slice("head", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda s, x: s + x.chars)
    heads = convs.select("conv_id", "length", "head", F.posexplode("head").alias("i", "x")).select("conv_id", (F.col("i") + 1).cast("long").alias("depth"), "x.key", "x.chars", rest.alias("rest"))
    own = turns.join(convs.drop("head"), "conv_id").where("position > h")
    own = own.select("conv_id", (F.col("m") + F.col("position") - F.col("h")).alias("depth"), "key", "chars", (F.col("length") - F.col("gained") - F.col("upto") + F.col("lost") + F.col("chars")).alias("rest"))
    return convs.select("conv_id"), heads.unionByName(own)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (class, conv_id) rows as pieces of the members' lists, in one pass."""
    held: list[np.ndarray] = []
    key, n = None, 0

    def piece() -> tuple:
        ids = np.concatenate(held)
        return (*key, int(ids[0]), len(ids), ",".join(map(str, ids.tolist())).encode())

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 5 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["n_turns", "x", "y", "first", "n", "ids"])

    for b in batches:
        if not b.num_rows:
            continue
        cols = [np.asarray(column(b, c)) for c in ("n_turns", "x", "y")]
        ids, out, size = np.asarray(column(b, "conv_id")), [], 0
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for a, z in zip([0, *new], [*new, len(ids)], strict=True):
            now = tuple(int(c[a]) for c in cols)
            if held and (now != key or n >= PIECE):
                out.append(piece())
                size += len(out[-1][-1])
                held, n = [], 0
            key = now
            held.append(ids[a:z])
            n += z - a
            if size > 1 << 22:
                yield batch(out)
                out, size = [], 0
        if out:
            yield batch(out)
    if held:
        yield batch([piece()])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order as one row for each class; a hash's state is all that is held, however many members there are."""
    key, first, n, sha = None, 0, 0, None

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=pa.schema([("n_turns", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("rep", pa.int64()), ("k", pa.int64()), ("sha", pa.string())]))

    for b in batches:
        out = []
        for r in b.to_pylist():
            now = (r["n_turns"], r["x"], r["y"])
            if now == key:
                sha.update(b",")
                n += r["n"]
            else:
                if key is not None:
                    out.append((*key, first, n, sha.hexdigest()))
                key, first, n, sha = now, r["first"], r["n"], hashlib.sha256()
            sha.update(r["ids"])
        if out:
            yield batch(out)
    if key is not None:
        yield batch([(*key, first, n, sha.hexdigest())])


def classes_of(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """``(rep, k, n_turns, sha)``: equal conversations, named by the smallest conv_id, with the SHA-256 of all members' ids in order.

    A hash over a list needs its pieces in order, so a class's list meets in one task; it comes there in pieces of 65536 ids and is streamed.
    """
    x = lambda *more: F.bit_xor(F.xxhash64("depth", "key", *more))
    signs = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), x().alias("x"), x(F.lit(1)).alias("y"))
    all_ = convs.join(signs, "conv_id", "left").select(*(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_turns", "x", "y")), "conv_id")
    order = ["n_turns", "x", "y", "conv_id"]
    pieces = all_.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_listed, "n_turns long, x long, y long, first long, n long, ids binary")
    ordered = pieces.repartition("n_turns", "x", "y").sortWithinPartitions("n_turns", "x", "y", "first")
    return ordered.mapInArrow(_hashed, "n_turns long, x long, y long, rep long, k long, sha string").select("rep", "k", "n_turns", "sha")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _written_by_band(turns: DataFrame) -> DataFrame:
    """Written in bands of depth (1, 2-3, 4-7, ...), so that a level reads its own band only."""
    return written(turns.withColumn("band", F.length(F.bin("depth"))), "band")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The trie of ``convs(conv_id)`` with ``turns(conv_id, depth, key, chars, rest)``; ``rest``: characters from this turn to the end.

    A row for each node: ``depth``, ``conv_id`` (smallest member), ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``
    (childless nodes below, itself included), ``saved_tokens`` (characters that sharing saves below, itself included) and
    ``ends_sha256`` over the ids of members that end here.
    """
    turns = written(turns)
    classes = written(classes_of(convs, turns))
    reps = _written_by_band(classes.select(F.col("rep").alias("conv_id"), "rep", "k", "n_turns").join(turns, "conv_id").drop("conv_id"))

    def level_of(live: DataFrame, d: int) -> DataFrame:
        """Live conversations with their turn at depth d; those that have ended have no key."""
        here = reps.where((F.col("band") == d.bit_length()) & (F.col("depth") == d))
        return written(live.join(here, "rep", "left").select("parent", "key", "rep", "k", "n_turns", "chars", "rest"))

    no = F.lit(0).cast("long")
    root = classes.agg(F.min("rep").alias("conv_id"), F.sum("k").alias("n_convs")).where("conv_id is not null")
    root = written(root.select("conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.lit(2).cast("long").alias("n_classes"), no.alias("n_turns"), no.alias("chars"), no.alias("rest")))
    levels, ends = [root], []
    rows = level_of(classes.select("rep").join(F.broadcast(root.select(F.col("conv_id").alias("parent")))), 1)
    while True:
        d = len(levels)
        ends.append(rows.where("key is null").select("rep", F.col("parent").alias("conv_id"), F.lit(d - 1).cast("long").alias("depth")))
        rows = rows.where("key is not null")
        if not rows.limit(1).count():
            break
        one = [F.any_value(c).alias(c) for c in ("n_turns", "chars", "rest")]
        nodes = rows.groupBy("parent", "key").agg(F.min("rep").alias("conv_id"), F.sum("k").alias("n_convs"), F.count("*").alias("n_classes"), *one)
        levels.append(nodes.withColumnRenamed("parent", "parent_conv_id").drop("key"))
        shared = nodes.where("n_classes > 1").select("parent", "key", "conv_id")
        rows = level_of(rows.select("parent", "key", "rep").join(shared, ["parent", "key"]).select("rep", F.col("conv_id").alias("parent")), d + 1)

    done, sums = [], root.select("conv_id", no.alias("c"), no.alias("leaves"), no.alias("saved")).where("false")
    for d in range(len(levels) - 1, -1, -1):
        single = F.col("n_classes") == 1
        rolled = written(
            levels[d].join(sums, "conv_id", "left").select(
                F.lit(d).cast("long").alias("depth"), "conv_id", "parent_conv_id", "n_convs", F.when(single, (F.col("n_turns") > d).cast("long")).otherwise(F.coalesce("c", no)).alias("n_children"), F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"),
                F.when(single, (F.col("n_convs") - 1) * F.col("rest")).otherwise((F.col("n_convs") - 1) * F.col("chars") + F.coalesce("saved", no)).alias("saved_tokens"), single.alias("single"),
            )
        )
        done.append(rolled)
        sums = rolled.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("c"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    upper = _union(done)

    heads = upper.where("single").select(F.col("conv_id").alias("rep"), F.col("depth").alias("top"))
    deeper = heads.join(reps.drop("band", "key", "chars"), "rep").where("depth > top")
    below = deeper.select("depth", F.col("rep").alias("conv_id"), F.col("rep").alias("parent_conv_id"), F.col("k").alias("n_convs"), (F.col("depth") < F.col("n_turns")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("k") - 1) * F.col("rest")).alias("saved_tokens"))
    ends.append(heads.select("rep", F.col("rep").alias("conv_id"), F.lit(None).cast("long").alias("depth")))
    ended = _union(ends).join(classes, "rep").select(F.coalesce("depth", "n_turns").alias("depth"), "conv_id", "sha")
    all_ = upper.drop("single").unionByName(below).join(ended, ["depth", "conv_id"], "left")
    return all_.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(EMPTY_SHA256)).alias("ends_sha256"))


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(*with_shared_heads(ordered_turns(table(spark, sf_dir, "conversations"))))


#: CRC-32 by its polynomial, bit by bit; every prefix of every rebuilt conversation as a list.
ORACLE_SQL = """
with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as i,
 {'r': coalesce(role, ''), 't': coalesce(text, '')} as x from conversations where conv_id is not null),
c as (select conv_id, list(x order by i) as own from t group by conv_id),
steps as (select conv_id, own, list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(conv_id::varchar)), lambda j: ascii((conv_id::varchar)[j + 1])::bigint)),
 lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda v, n: case when v % 2 = 1 then xor(v // 2, 3988292384::bigint) else v // 2 end)) as crc from c),
h as (select conv_id, own, (xor(crc, 4294967295::bigint) % 6)::bigint as h, conv_id - conv_id % 100 as base from steps),
seqs as (select h.conv_id, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) as s from h left join c b on b.conv_id = h.base),
p as (select conv_id, d, s[1:d] as prefix, len(s) = d as ended, s from (select conv_id, s, unnest(range(len(s) + 1)) as d from seqs)),
n as (select d, prefix, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ended), '')) as ends_sha256, case when d = 0 then 0 else length(any_value(prefix)[d].t) end as chars from p group by d, prefix),
e as (select n.*, m.conv_id as parent_conv_id from n left join n m on m.d = n.d - 1 and m.prefix = n.prefix[1:n.d - 1]),
k as (select d - 1 as d, parent_conv_id as conv_id, count(*) as n_children from e where d > 0 group by all),
f as (select e.*, coalesce(n_children, 0) as n_children from e left join k using (d, conv_id)),
up as (select a.d, a.conv_id, count(*) filter (f.n_children = 0) as n_leaves, sum((f.n_convs - 1) * f.chars) as saved from f join p q on q.d >= f.d and q.conv_id = f.conv_id and q.d = f.d join f a on a.d <= f.d and a.prefix = q.prefix[1:a.d] group by a.d, a.conv_id)
select f.conv_id, f.d::bigint as depth, f.parent_conv_id, f.n_convs::bigint as n_convs, f.n_children::bigint as n_children, up.n_leaves::bigint as n_leaves, up.saved::bigint as saved_tokens, f.ends_sha256 from f join up using (d, conv_id)
"""
