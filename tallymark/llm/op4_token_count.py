"""Token counts of whole texts under a public byte-level BPE vocabulary.

An Arrow function gives back lengths only. Texts are split at safe boundaries: before a single space
between two characters that are not white space, where the vocabulary's own splitting always
begins a new piece, so that counts of parts add up to the count of the whole. What lies between two
boundaries repeats a great deal, so each distinct part is encoded once for a worker's life, in
batches balanced by bytes.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import bounded_batches, column, table, tokenizer_path

BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
#: Where a long stretch without such a space can be cut: no piece of the vocabulary's splitting goes from letters to digits or back.
WITHOUT_SPACE = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
#: Bytes in one call of the encoder, characters of a text split at a time, parts remembered by a worker.
BATCH_BYTES, WINDOW_CHARS, REMEMBERED = 256 << 10, 1 << 20, 400_000


def n_bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


class PartCounter:
    """Token counts of text parts, with the parts seen so far remembered up to a bound."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._encoder = Tokenizer.from_file(path)
        self._encoder.no_truncation()
        self._encoder.no_padding()
        self._known: dict[str, int] = {}

    def _learn(self, parts: set[str]) -> None:
        batch, size = [], 0
        for part in [*parts, None]:
            if batch and (part is None or size + n_bytes(part) > BATCH_BYTES):
                self._known.update(zip(batch, (len(x.ids) for x in self._encoder.encode_batch_fast(batch, add_special_tokens=False)), strict=True))
                batch, size = [], 0
            if part is not None:
                batch.append(part)
                size += n_bytes(part)

    def count(self, texts: list[str]) -> list[int]:
        counts = []
        for text in texts:
            total = 0
            for parts in split_parts(text):
                new = {x for x in parts if x not in self._known}
                if len(self._known) + len(new) > REMEMBERED:
                    self._known.clear()
                    new = set(parts)
                self._learn(new)
                total += sum(map(self._known.__getitem__, parts))
            counts.append(total)
        return counts


def split_parts(text: str) -> Iterator[list[str]]:
    """The parts of a text between safe boundaries, a bounded stretch at a time; each keeps its leading space."""
    start = 0
    while start < len(text):
        far = start + WINDOW_CHARS
        cut = len(text) > far and (BOUNDARY.search(text, far, far + WINDOW_CHARS) or WITHOUT_SPACE.search(text, far) or BOUNDARY.search(text, far))
        end = cut.start() if cut else len(text)
        first, *rest = BOUNDARY.split(text[start:end])
        # A stretch after the first begins with the space of its boundary, which splits off no part of its own.
        yield [first, *(" " + x for x in rest)]
        start = end


@functools.cache
def _counter(path: str) -> PartCounter:
    return PartCounter(path)


def _counted(batches, vocabulary: str):
    counter = _counter(tokenizer_path(vocabulary))
    for batch in batches:
        counts = counter.count(column(batch, "text").to_pylist())
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row of ``docs(doc_id, text)``.

    Null texts count as empty: no bytes, no tokens. No begin, end or other special tokens are added;
    special strings inside a text count as the library reads them by default. Nothing is truncated. Repeated rows are counted alike, and other
    columns are ignored. A very long text is encoded in stretches of about a million characters, cut before a space or between a letter and a digit; one
    of letters alone for longer than that (no spaces, no digits, no marks) is a single piece to the vocabulary, which has no boundary inside, and is encoded whole.
    """
    bounded_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = rows.mapInArrow(lambda b: _counted(b, vocabulary), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
