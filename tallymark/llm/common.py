"""What several corpus operators share: word splitting in Arrow, stable hashes, written intermediate tables."""

from __future__ import annotations

import math
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these: space, tab, newline, vertical tab, form feed, carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SEPARATORS = " \t\n\x0b\x0c\r"

_M1, _M2, _BASE = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, *by: str) -> DataFrame:
    """The same rows, written as Parquet to the shared checkpoint folder, in a folder for each value of ``by``, and read back.

    Cuts the lineage, so that a lost executor costs no recomputation from the texts, and lets later
    steps read single columns. The folder is the session's ``spark.checkpoint.dir``; where that is
    unset, a local session makes a temporary one, and on a cluster this is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    path = f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many texts, so that a task holds little at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def corpus_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts; sizes blocks and shards so that their number follows the input."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def block_count(n_bytes: int, block_bytes: int) -> int:
    return max(1, math.ceil(n_bytes / block_bytes))


def column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    got = batch.column(batch.schema.get_field_index(name))
    return got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words of each text: index of every word into the distinct words, offsets by text, distinct words.

    ``lower`` folds A-Z only. Null texts have no words.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = parts.flatten()
    offsets = np.asarray(parts.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(np.asarray(full), dtype=np.int64)])
    coded = flat.filter(full).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return np.asarray(coded.indices, dtype=np.int64), kept[offsets], [w.encode() for w in coded.dictionary.to_pylist()]


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def window_hashes(h: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin fingerprints of all windows of k words that stay within one text, and their start positions."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    acc = h[:n].copy()
    for t in range(1, k):
        acc = acc * _BASE + h[t : t + n]
    inside = np.ones(n, bool)
    ends = offsets[1:-1] if len(offsets) > 2 else np.empty(0, np.int64)
    for t in range(1, k):
        cut = ends - t
        inside[cut[(cut >= 0) & (cut < n)]] = False
    at = np.flatnonzero(inside)
    return mixed(acc[at]), at


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; the folder can be named in PUBLIC_TOKENIZERS_DIR."""
    if folder := os.environ.get("PUBLIC_TOKENIZERS_DIR"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)
