"""Secrets in texts: fixed patterns, and strings that compression finds new where secrets stand.

Beyond the patterns, every long string of mixed characters that follows a sensitive word closely is a
candidate, and so is each that follows a candidate as closely (parts of a token, lines of a key). A string that a
sensitive word assigns (``pwd=``, ``auth: ``) may be shorter, and one of letters alone must be long or change case often. A
zstandard compressor is primed with the text around it and a dictionary of identifiers; how many bytes
the candidate adds to its compressed surroundings is its novelty. Names, paths and repeated values add
few bytes, keys and passwords nearly as many as random characters of their alphabet. Strings of over
PIECE characters are judged in pieces and are found whole if one piece is new.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
import string
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import bounded_batches, column, table

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_SENSITIVE = re.compile(r"(?:{0})(?:[-_/+]?(?:{0}))*".format("key|pwd|pass|auth|cred|bearer|login|signature|private|session|salt|cert|secret|token"), re.IGNORECASE | re.ASCII)
#: What joins a sensitive word to a candidate; '=' and all else that no candidate has needs no mention.
_JOINT = re.compile(r"[-_/+]*")
#: '=' begins no candidate and ends one only as padding.
_START = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}+(?:=++(?![A-Za-z0-9+/_-]))?")
#: The last line of an armoured key may be shorter than a candidate.
_LAST_LINE = re.compile(r"(?:\\[nr]|[\s\"',+])*([A-Za-z0-9+/]{1,15}=*)(?:\\[nr]|[\s\"',+])*-----END")
#: What stands between a sensitive word and a value that it assigns, and such a value.
_ASSIGNED = re.compile(r"""["']?\x20*(?::=|=>|[:=])\x20*["']?([A-Za-z0-9+/_!@#$%^&*.~-]{10,}+)""")
PIECE = 256
_ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/_-=")
#: Words of code and configuration that don't make a string new.
IDENTIFIERS = (
    "access account address admin algorithm application authentication authorization background backend base bearer boolean bucket buffer build cache callback certificate character "
    "class client cluster column command comment commit component config configuration connection console constant container content context controller cookie counter credential "
    "database dataset debug default define delete dependency description development device dictionary directory document domain download element email enable encode encoding endpoint "
    "environment error event example exception export expression extension false feature field filename filter folder format frontend function gateway generate global handler hash header "
    "height hostname identifier image implement import include index information initialize input instance integer interface internal issuer iterator javascript kubernetes language latest "
    "length library license listener local location logger login manager memory message metadata method migration model module monitor namespace network node notification number object "
    "operation option order organization output package padding parameter parent password path pattern payload pipeline platform plugin pointer policy position postgres prefix private process "
    "production profile project property protocol provider public python query queue record redirect reference region register release remote repository request resource response result "
    "return revision router runtime sample schedule schema scope script secret security select sequence server service session setting signature socket source staging static status storage "
    "string structure subject suffix system table target template terminal test thread timeout timestamp token transaction true undefined update upload user username validate value variable "
    "vendor version volume warning webhook widget width window worker workspace 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"
).encode()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns' matches."""
    spans = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # A run shorter than 24 is dropped whole, so looking for longer ones alone finds the same.
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def novelty(candidate: str, before: str, after: str) -> float:
    """Compressed bytes that the candidate adds for each of its characters, given its surroundings."""
    primer = IDENTIFIERS + (after + "\n" + before).encode()
    compressor = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False)
    tail = before[-16:].encode()
    return (len(compressor.compress(tail + candidate.encode())) - len(compressor.compress(tail))) / len(candidate)


@lru_cache(4 * PIECE)
def _random_novelty(n: int, alphabet: str) -> float:
    return novelty("".join(random.Random(n).choices(alphabet, k=n)), "", "")


def is_new(candidate: str, before: str, after: str, least: float) -> bool:
    """Whether its novelty is ``least`` times that of random characters of its alphabet; the coder packs those from some 64 on."""
    got = novelty(candidate, before, after)
    return got >= least or len(candidate) > 32 and got >= least * _random_novelty(len(candidate), next(a for a in _ALPHABETS if set(candidate) <= set(a)))


def _mixed(candidate: str) -> bool:
    """Letters with digits, or letters alone that change case often or go on for 24 characters."""
    digit, lower, upper = (any(map(f, candidate)) for f in (str.isdigit, str.islower, str.isupper))
    if digit:
        return lower or upper
    changes = sum(a.isupper() != b.isupper() for a, b in zip(candidate, candidate[1:], strict=False) if a.isalpha() and b.isalpha())
    return len(candidate) >= 24 and candidate.isalpha() and max(map(candidate.lower().count, set(candidate.lower()))) <= len(candidate) / 5 or changes * 6 >= len(candidate)


def novel_spans(text: str, taken: list[tuple[int, int, int]], reach: int, around: int, least: float) -> list[tuple[int, int, int]]:
    """New strings near sensitive words, outside ``taken`` spans, which are sorted by their starts."""
    spans, done = [], -1
    starts, furthest = [s for s, _, _ in taken], list(accumulate((e for _, _, e in taken), max))

    def is_hit(start: int, end: int) -> bool:
        before = bisect_left(starts, end)  # so many taken spans begin before its end; the furthest of them must not reach into it
        if before and furthest[before - 1] > start:
            return False
        step = math.ceil((end - start) / math.ceil((end - start) / PIECE))
        pieces = ((i, min(end, i + step)) for i in range(start, end, step))
        return any(is_new(text[i:j], text[max(0, i - around) : i], text[j : j + around], least) for i, j in pieces)

    for w in _SENSITIVE.finditer(text):
        joint = _JOINT.match(text, w.end()).end()
        if joint > w.end() and joint + 16 <= done and not (spans and spans[-1][2] > joint):
            # Within a string that is not new as a whole: from here on it may be. One piece, as there may be many such words.
            if _mixed(text[joint : min(done, joint + PIECE)]) and is_hit(joint, min(done, joint + PIECE)):
                spans.append((joint, 3, done))
        if (v := _ASSIGNED.match(text, w.end())) and len(v[1]) < 16 and v.start(1) >= done and _mixed(v[1]) and is_hit(v.start(1), v.end(1)):
            spans.append((v.start(1), 3, v.end(1)))
            done = v.end(1)
        at, last = max(w.end(), done), w.end() + reach
        m = _RUN.match(text, joint) if joint > w.end() >= done else None
        while m or (s := _START.search(text, at, max(at, last + 16))):
            m = m or _RUN.match(text, s.start())
            at = done = m.end()
            if _mixed(m[0]):
                last = done + reach
                if is_hit(m.start(), done):
                    spans.append((m.start(), 3, done))
                    if end := _LAST_LINE.match(text, done):
                        spans.append((end.start(1), 3, end.end(1)))
                        at = done = end.end(1)
            m = None
    return spans


def find_secrets(text: str | None, reach: int = 32, around: int = 512, least: float = 0.8) -> list[tuple[int, int, int]]:
    """All spans ``(start, kind, end)`` in code points, sorted; kinds as in KINDS."""
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, reach, around, least))


def redacted(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span replaced; overlapping spans are replaced as one."""
    spans = find_secrets(text)
    if not spans:
        return text
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scanned(batches):
    for batch in batches:
        found = [find_secrets(t) for t in column(batch, "text").to_pylist()]
        base = [[x for x in f if x[1] < 3] for f in found]
        yield pa.RecordBatch.from_arrays(
            [column(batch, "doc_id"), *(pa.array([sum(k == i for _, k, _ in b) for b in base], pa.int64()) for i in range(3)), pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base]), pa.array([_joined(f) for f in found])],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scan(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of every row of ``docs(doc_id, text)``; other columns are ignored.

    Null texts count as empty, without spans. Repeated rows are judged alike. Texts are scanned whole and candidates have
    no upper length. A string of equal standing again within 512 characters is not new.
    """
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_scanned, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, with secrets in ``text`` replaced, and ``n_chars`` (if there) brought up to date."""
    bounded_batches(docs.sparkSession)

    def cleaned(batches):
        for batch in batches:
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, batch.schema.field(i), pa.array([redacted(t) for t in column(batch, "text").to_pylist()], batch.schema.field(i).type))

    out = docs.mapInArrow(cleaned, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return out


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
