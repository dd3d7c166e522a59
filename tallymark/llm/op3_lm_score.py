"""Language-model scores by a weighted backoff automaton.

The model is a trigram model: each order is smoothed by the one below with a Dirichlet prior (MacKay
and Peto), the lowest is an add-one unigram model. A state is a context of up to two words; a seen
n-gram is an arc, a state without an arc for the next word follows its failure arc, whose weight
``k / (c + k)`` is what smoothing leaves to unseen words, to the state of the shorter context. One pass
from left to right carries the state and adds up log10 probabilities. The state after a word is
fixed by the last two, so a block's texts take their steps as arrays.

The automaton of a whole corpus fits no executor, so none is ever built whole. Texts are hashed into
blocks. Each block sends its distinct n-grams of all orders, with their counts in the training part, to
shards as sorted, packed fingerprints; a shard adds up all blocks' counts and answers each block
in the same order. A context's count is that of its own n-gram, so weights of arcs and failure arcs follow, and
every block gets the part of the automaton that its texts can reach. N-grams are spread by
their whole fingerprint: the successors of a frequent word lie in all shards, and a frequent n-gram
costs one entry a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import block_count, bounded_batches, column, corpus_bytes, hash_words, mixed, split_words, table

#: Stand for the start of a text and its end; no word has these hashes but by a chance of 2**-64.
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
#: Strength of the prior of bigrams and trigrams; the automaton's order is one more than there are.
STRENGTH = (16.0, 2.0)
#: Bits of a fingerprint besides those that tell shards apart; of the millions in a shard, one agrees with another by a chance of millions to 2**48.
BITS = 48
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _packed(x: np.ndarray, width: int) -> bytes:
    """Numbers below 256 ** width by planes of bytes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())


def _unpacked(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and offsets by text; each text has its end as last token."""
    index, offsets, words = split_words(texts)
    out = offsets + np.arange(len(offsets))
    here = np.full(out[-1], END, np.uint64)
    is_word = np.ones(out[-1], bool)
    is_word[out[1:] - 1] = False
    if len(index):
        here[is_word] = hash_words(words)[index]
    return here, out


def _shifted(x: np.ndarray, out: np.ndarray, first: np.ndarray | np.uint64) -> np.ndarray:
    """For every token what the one before it has, ``first`` for a text's first."""
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[out[:-1]] = first
    return before


def _grams(here: np.ndarray, out: np.ndarray, orders: int, n_shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of the distinct n-grams of the orders 1 to ``orders``, sorted; their shards, which follow that order; by order and token which n-gram it is."""
    codes, context, before = [], np.zeros_like(here), here
    for n in range(orders):
        codes.append(mixed((context + np.uint64(n + 1)) * _PRIME ^ here))
        before = _shifted(before, out, START)
        context = mixed(context * _PRIME + before)
    drop = np.uint64(max(0, 64 - BITS - n_shards.bit_length()))
    distinct, which = np.unique(np.concatenate(codes) >> drop, return_inverse=True)
    shard = (((distinct >> (np.uint64(32) - drop)) * np.uint64(n_shards)) >> np.uint64(32)).astype(np.int64)
    return distinct, shard, which.reshape(orders, -1)


def walk(root: np.ndarray, counts: np.ndarray, contexts: np.ndarray, strength: tuple[float, ...]) -> np.ndarray:
    """Log10 weight of each token's step: of the arc if its state has one, else of the failure arc and the step from there.

    ``root`` are steps from the root; rows of ``counts`` and ``contexts`` are the longer orders, from short to long.
    """
    step = root
    for n, c, k in zip(counts, contexts, strength, strict=True):
        step = np.where(n > 0, np.log10((n + k * 10.0**step) / (c + k)), np.log10(k / (c + k)) + step)
    return step


def _vocabulary(batches, n_buckets: int, held: int = 1 << 20):
    """Distinct word hashes by bucket, and in the first row of each message how many words they stand for."""
    known, count = np.empty(0, np.uint64), 0

    def message():
        bucket = (known % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
        got = [order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([int(bucket[g[0]]) for g in got]), pa.array([count] + [0] * (len(got) - 1)), pa.array([known[g].tobytes() for g in got])], names=["bucket", "n", "words"])

    for batch in batches:
        rows = batch.filter(column(batch, "train"))
        index, _, words = split_words(column(rows, "text"))
        if len(index):
            known = np.unique(np.concatenate([known, hash_words(words)]), return_index=True)[0]
            count += len(index)
            if len(known) > held:
                yield message()
                known, count = known[:0], 0
    if count:
        yield message()


def _distinct_words(rows):
    h = np.sort(np.frombuffer(b"".join(column(rows, "words").to_pylist()), np.uint64))
    return pa.table({"n": pa.array([sum(column(rows, "n").to_pylist())]), "v": pa.array([int((h[1:] != h[:-1]).sum()) + 1])})


def _asked(rows: pa.Table, block: int, orders: int, n_shards: int) -> pa.Table:
    here, out = _tokens(column(rows, "text"))
    codes, shard, which = _grams(here, out, orders, n_shards)
    train = np.repeat(np.asarray(column(rows, "train")), np.diff(out))
    counts = np.bincount(which.ravel(), weights=np.tile(train, orders), minlength=len(codes)).astype(np.int64)
    edges = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
    got = [(int(shard[i]), block, _packed(np.diff(codes[i:j], prepend=np.uint64(0)), 8), _packed(counts[i:j], 5)) for i, j in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table([pa.array([x[i] for x in got], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["shard", "block", "keys", "counts"])


def _answered(rows):
    """For each block that asked, what all the others have besides its own counts."""
    keys = [np.cumsum(_unpacked(x, 8), dtype=np.uint64) for x in column(rows, "keys").to_pylist()]
    counts = [_unpacked(x, 5).astype(np.int64) for x in column(rows, "counts").to_pylist()]
    _, which = np.unique(np.concatenate(keys), return_inverse=True)
    own = np.concatenate(counts)
    others = np.bincount(which, weights=own).astype(np.int64)[which] - own
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    return pa.table({"block": column(rows, "block"), "shard": column(rows, "shard"), "others": pa.array([_packed(x, 6) for x in np.split(others, cuts)], pa.binary())})


def _scored(docs: pa.Table, answers: pa.Table, n_shards: int, n_tokens: int, n_kinds: int, strength: tuple[float, ...]) -> pa.Table:
    here, out = _tokens(column(docs, "text"))
    codes, _, which = _grams(here, out, len(strength) + 1, n_shards)
    train = np.repeat(np.asarray(column(docs, "train")), np.diff(out))
    totals = np.bincount(which.ravel(), weights=np.tile(train, len(which)), minlength=len(codes)).astype(np.int64)
    got = sorted(zip(column(answers, "shard").to_pylist(), column(answers, "others").to_pylist(), strict=True))
    totals += np.concatenate([_unpacked(x, 6) for _, x in got] or [np.empty(0, np.uint64)]).astype(np.int64)
    counts = totals[which]
    # A context's count is that of its own n-gram where the word before stands; a start's is the number of texts, which every end has.
    texts = counts[0][out[1:] - 1]
    contexts = np.stack([_shifted(c, out, texts) for c in counts[:-1]])
    root = np.log10((counts[0] + 1) / (n_tokens + n_kinds + 1))
    step = walk(root, counts[1:], contexts, strength)
    return pa.table({
        "doc_id": column(docs, "doc_id"), "held_out": pa.array(~np.asarray(column(docs, "train"))), "n_tokens": pa.array(np.diff(out)),
        "n_known": pa.array(np.add.reduceat((counts[0] > 0).astype(np.int64), out[:-1])), "train_tokens": pa.array(np.full(len(out) - 1, n_tokens, np.int64)),
        "base_score": pa.array(np.round(np.add.reduceat(root, out[:-1]), 6)), "score": pa.array(np.round(np.add.reduceat(step, out[:-1]), 6)),
    })


def sized_blocks(n_bytes: int, least: int = 8 << 20, most: int = 64 << 20, upto: int = 30 << 30) -> int:
    """How many blocks: of ``least`` bytes for inputs up to ``upto``, then growing by the root of the input, so that messages between blocks and shards stay filled."""
    return block_count(n_bytes, int(min(most, least * max(1.0, n_bytes / upto) ** 0.5)))


def score_texts(docs: DataFrame, train: str = "crc32(coalesce(cast(doc_id as string), '')) % 7 <> 2", strength: tuple[float, ...] = STRENGTH, block_bytes: int | None = None) -> DataFrame:
    """Log10 probability of every text of ``docs(doc_id, text)`` under a model learnt from the rows where ``train`` holds.

    ``strength`` has the priors of the orders from two on, three orders in all by default. Null texts
    count as empty; a text without words is its end alone. Rows are scored one by one, so repeated rows and
    ids are too, and each counts as often as it stands; a row without id trains like id "". Without
    training rows every token has the same probability. A block takes as much memory as its texts, and a single text is never split.
    Scores are rounded to 6 decimals. Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.expr(train), F.lit(True)).alias("train"))
    n_bytes, orders = corpus_bytes(rows), len(strength) + 1
    n = block_count(n_bytes, block_bytes) if block_bytes else sized_blocks(n_bytes)
    # Words of the training part: how many there are, and how many different ones.
    words = rows.select("text", "train").mapInArrow(lambda b: _vocabulary(b, n), "bucket long, n long, words binary")
    ends = rows.agg(F.count_if("train")).first()[0]
    found = words.groupBy("bucket").applyInArrow(_distinct_words, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    n_tokens, n_kinds = (found[0] or 0) + ends, (found[1] or 0) + (ends > 0)
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)))

    def asked(key, rows):
        return _asked(rows, key[0].as_py(), orders, n)

    def scored(texts, answers):
        return _scored(texts, answers, n, n_tokens, n_kinds, strength)

    messages = blocks.groupBy("block").applyInArrow(asked, "shard long, block long, keys binary, counts binary")
    answers = messages.groupBy("shard").applyInArrow(_answered, "block long, shard long, others binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
