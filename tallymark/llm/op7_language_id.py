"""Language identification by unigram models over a fixed public vocabulary, summed over all segmentations.

For each language, the probabilities of the vocabulary's pieces are fitted by expectation
maximisation to words of a bounded, stratified sample of labelled texts. A word's probability is the
sum over every way to cut it into pieces, by the forward algorithm; a text's is the product over its
words. Pieces don't cross words, so each distinct word is summed once for all its occurrences.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import bounded_batches, column, split_words, table, tokenizer_path, written

_RUN = re.compile(r"[^\W\d_]+")
START = "▁"
#: Training cuts letter runs into words of so many letters; words summed at a time; probabilities remembered and summed by a worker.
TRAIN_WORD, CHUNK, CELLS = 64, 20_000, 4_000_000


def letter_runs(word: str) -> list[str]:
    """Lower-case runs of letters in a word."""
    low = word.lower()
    return [low] if low.isalpha() else [r for r in _RUN.findall(low) if any(map(str.isalpha, r))]


@functools.cache
def vocabulary(name: str) -> dict[str, int]:
    """Index of every piece of lower-case letters, with or without the mark of a word's start."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=tokenizer_path(name))
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    fit = [p for p in pieces if (b := p.removeprefix(START)) == b.lower() and all(map(str.isalpha, b))]
    return {p: i for i, p in enumerate(dict.fromkeys(fit))}


@functools.cache
def _beginnings(pieces: tuple[str, ...]) -> dict[str, int]:
    """Every beginning of a piece, with the piece's index if it is one itself, else -1."""
    return {p[:n]: -1 for p in pieces for n in range(1, len(p))} | {p: i for i, p in enumerate(pieces)}


@functools.cache
def _longest(pieces: tuple[str, ...]) -> int:
    return max(map(len, pieces), default=1)


class Lattice:
    """All pieces that fit into each of some words: an edge from where a piece begins to where it ends.

    A character that is no piece is the unknown piece, whose index is the vocabulary's size. Edges are packed into 63 bits, with as many for
    each part as these words and this vocabulary need; what doesn't fit is an error.
    """

    def __init__(self, words: list[str], pieces: dict[str, int]):
        unknown, edges, names = len(pieces), [], tuple(pieces)
        add, get = edges.append, _beginnings(names).get
        for_piece, for_size, for_start = unknown.bit_length(), _longest(names).bit_length(), max(map(len, words), default=0).bit_length() + 1
        if for_piece + for_size + for_start + len(words).bit_length() > 63:
            raise ValueError("too many words, or pieces or words that are too long, for one lattice")
        low = for_piece + for_size
        for n, w in enumerate(words):
            s = START + w
            for i in range(len(s)):
                head = (n << for_start | i) << low  # word, start; then length and piece
                p = get(s[i], -1)
                add(head | 1 << for_piece | (p if p >= 0 else unknown))
                for j in range(i + 2, len(s) + 1):
                    p = get(s[i:j])
                    if p is None:
                        break
                    if p >= 0:
                        add(head | (j - i) << for_piece | p)
        code = np.array(edges, np.int64)
        self.length = np.array([len(w) + 1 for w in words], np.int64)
        self.word, self.start, self.piece = code >> for_start + low, code >> low & (1 << for_start) - 1, code & (1 << for_piece) - 1
        size = code >> for_piece & (1 << for_size) - 1
        self.end, self.reach = self.start + size, int(size.max(initial=1))

    def _by(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges by place and word, and where the edges of each place begin."""
        order = np.lexsort((self.word, at))
        return order, np.searchsorted(at[order], np.arange(int(self.length.max(initial=0)) + 2))

    def _step(self, p: np.ndarray, e: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the edges ``e``, which lie together by word, from what is ``before`` each: words and their sums."""
        w = self.word[e]
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        return w[first], np.add.reduceat(before * p[self.piece[e]], first)

    def log_sums(self, p: np.ndarray) -> np.ndarray:
        """Log-probability of each word (rows) in each language (columns of ``p``, rows of which are pieces).

        Only as many places as the longest piece reaches back are held, so long words take no more memory than short ones.
        """
        order, cut = self._by(self.end)
        turn = self.reach + 1
        ring, scale = np.zeros((turn, len(self.length), p.shape[1])), np.zeros((len(self.length), p.shape[1]))
        ring[0], out = 1, np.zeros_like(scale)
        for t in range(1, int(self.length.max(initial=0)) + 1):
            now = ring[t % turn]
            now[:] = 0
            if len(e := order[cut[t] : cut[t + 1]]):
                w, sums = self._step(p, e, ring[self.start[e] % turn, self.word[e]])
                now[w] = sums
                if (low := (now < 1e-150) & (now > 0)).any():  # lift the stretch that later pieces can begin in
                    ring[:, low] *= 1e150
                    scale[low] -= 150 * math.log(10)
                whole = self.length[w] == t
                out[w[whole]] = np.log(now[w[whole]]) + scale[w[whole]]
        return out

    def _summed(self, p: np.ndarray, at: np.ndarray, source: np.ndarray, stops: range) -> np.ndarray:
        """Sums over all paths to each place in one language, by place and word."""
        n, deep = len(self.length), int(self.length.max(initial=0)) + 1
        total = np.zeros((deep, n, 1))
        order, cut = self._by(at)
        if stops.step < 0:
            total[self.length, np.arange(n)] = 1
        else:
            total[0] = 1
        for t in stops:
            if len(e := order[cut[t] : cut[t + 1]]):
                w, sums = self._step(p, e, total[source[e], self.word[e]])
                total[t, w] += sums
        return total

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in one language, for words that occur so often."""
        p = p[:, None]
        deep = int(self.length.max(initial=0))
        ahead = self._summed(p, self.end, self.start, range(1, deep + 1))
        back = self._summed(p, self.start, self.end, range(deep - 1, -1, -1))
        whole = np.maximum(ahead[self.length, np.arange(len(self.length)), 0], 1e-300)
        use = ahead[self.start, self.word, 0] * p[self.piece, 0] * back[self.end, self.word, 0] * (counts / whole)[self.word]
        return np.bincount(self.piece, weights=use, minlength=len(p))


def fit_language(words: list[str], counts: np.ndarray, pieces: dict[str, int], rounds: int, alpha: float) -> np.ndarray:
    """Piece probabilities by expectation maximisation from equal ones, with ``alpha`` added to each expected count."""
    p = np.full(len(pieces) + 1, 1 / (len(pieces) + 1))
    by_length = sorted(range(len(words)), key=lambda i: (len(words[i]), words[i]))
    words, counts = [words[i] for i in by_length], counts[by_length]
    chunks = [(Lattice(words[i : i + CHUNK], pieces), counts[i : i + CHUNK]) for i in range(0, len(words), CHUNK)]
    for _ in range(rounds):
        p = sum(c.expected(p, n) for c, n in chunks) + alpha
        p /= p.sum()
    return p


class Scorer:
    """Log-probabilities of words in all languages, remembered up to a bound."""

    def __init__(self, p: np.ndarray, pieces: dict[str, int]):
        self._p, self._pieces = p, pieces
        self._row: dict[bytes, int] = {}
        self._known = np.empty((0, p.shape[1] + 1))

    def words(self, words: list[bytes]) -> np.ndarray:
        """A row for each word: its log-probabilities, and last whether it has a letter."""
        new = [w for w in words if w not in self._row]
        if (len(self._row) + len(new)) * self._p.shape[1] > CELLS:
            self._row, self._known, new = {}, self._known[:0], words
        if new:
            runs = [letter_runs(w.decode()) for w in new]
            flat = sorted({r for x in runs for r in x}, key=len)  # words of like length together
            at = {r: i for i, r in enumerate(flat)}
            logs = np.zeros((len(flat) + 1, self._p.shape[1]))
            i = 0
            while i < len(flat):
                j = i + max(1, min(CHUNK, 600_000 // (len(flat[min(i + CHUNK, len(flat)) - 1]) + 1), CELLS // (16 * self._p.shape[1])))
                logs[i : min(j, len(flat))] = Lattice(flat[i:j], self._pieces).log_sums(self._p)
                i = j
            rows = np.zeros((len(new), self._p.shape[1] + 1))
            owner = np.repeat(np.arange(len(new)), [len(x) for x in runs])
            np.add.at(rows[:, :-1], owner, logs[[at[r] for x in runs for r in x]])
            rows[owner, -1] = 1
            self._row.update((w, len(self._known) + i) for i, w in enumerate(new))
            self._known = np.concatenate([self._known, rows])
        return self._known[[self._row[w] for w in words]]


_SCORER: list = [None, None]


def _predicted(batches, key: str, model, name: str):
    langs, p = model.value
    if _SCORER[0] != key:
        _SCORER[:] = key, Scorer(p, vocabulary(name)) if langs else None
    for batch in batches:
        index, offsets, words = split_words(column(batch, "text"), lower=False)
        n = batch.num_rows
        best, score = np.full(n, -1), np.zeros(n)
        if langs and len(words):
            rows = _SCORER[1].words(words)
            owner = np.repeat(np.arange(n), np.diff(offsets))
            total = np.stack([np.bincount(owner, weights=rows[index, i], minlength=n) for i in range(len(langs))], axis=1)
            has = np.bincount(owner, weights=rows[index, -1], minlength=n) > 0
            odds = np.exp(total - total.max(axis=1, keepdims=True))
            best = np.where(has, total.argmax(axis=1), -1)
            score = np.where(has, 1 / odds.sum(axis=1), 0.0)
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "held_out"), pa.array([langs[i] if i >= 0 else "und" for i in best.tolist()], pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])


def _sample_words(batches):
    for batch in batches:
        index, offsets, words = split_words(column(batch, "text"), lower=False)
        langs = column(batch, "lang").to_pylist()
        runs = [letter_runs(w.decode()) for w in words]
        counts: dict[tuple[str, str], int] = {}
        for i, lang in enumerate(langs):
            for w in index[offsets[i] : offsets[i + 1]].tolist():
                for r in runs[w]:
                    for x in range(0, len(r), TRAIN_WORD):
                        key = lang, r[x : x + TRAIN_WORD]
                        counts[key] = counts.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])


def learn(docs: DataFrame, vocabulary_name: str, max_docs_per_lang: int, rounds: int = 4, alpha: float = 0.05) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities (a column each) from ``docs(text, lang, pick)``.

    A language gives at most about ``max_docs_per_lang`` texts, those first by the hash ``pick``: the bound of
    the classifier's sample. All languages are learnt; the driver gets one array of the vocabulary's size for each.
    """
    per = docs.groupBy("lang").count().orderBy("lang").collect()
    if not per:
        return [], np.empty((len(vocabulary(vocabulary_name)) + 1, 0))
    share = F.create_map(*[F.lit(x) for r in per for x in (r[0], min(1.0, max_docs_per_lang / r[1]))])
    sample = docs.where(F.pmod("pick", F.lit(1 << 53)) < share[F.col("lang")] * float(1 << 53))
    words = sample.select("text", "lang").mapInArrow(_sample_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def fitted(pdf):
        pdf = pdf.sort_values("word")
        p = fit_language(pdf["word"].tolist(), pdf["n"].to_numpy(float), vocabulary(vocabulary_name), rounds, alpha)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "p": [p.astype(np.float32).tobytes()]})

    models = sorted(map(tuple, written(words.groupBy("lang").applyInPandas(fitted, "lang string, p binary")).collect()))
    return [m[0] for m in models], np.stack([np.frombuffer(m[1], np.float32) for m in models], axis=1).astype(float) if models else np.empty((0, 0))


def identify(docs: DataFrame, held_out: str = "crc32(coalesce(cast(doc_id as string), '')) % 4 = 2", vocabulary_name: str = "piece_bpe_32k.model", max_docs_per_lang: int = 1500) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row of ``docs(doc_id, text, lang)``.

    Learns from rows with a language that are not held out; predicts from the text alone. ``score``
    is the language's posterior probability under equal priors. Null texts and texts without a letter
    are ``und`` with score 0, and so is everything if there is nothing to learn from. Equal
    probabilities go to the first language by name. Repeated rows are judged alike. A row without id trains like
    id "". Texts and letter runs may be of any length; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select("doc_id", "text", "lang", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"))
    train = rows.where("not held_out and lang is not null and text is not null").select("text", "lang", F.xxhash64("doc_id", "text").alias("pick"))
    langs, p = learn(train, vocabulary_name, max_docs_per_lang)
    model = spark.sparkContext.broadcast((langs, p))
    key = f"{spark.sparkContext.applicationId}-{model.id if hasattr(model, 'id') else id(model)}-{hash((tuple(langs), p.tobytes()))}"
    return rows.select("doc_id", "held_out", "text").mapInArrow(lambda b: _predicted(b, key, model, vocabulary_name), "doc_id long, held_out boolean, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
