"""Secret scan: fixed patterns, and strings that a primed zstandard can't compress.

In code and prose names repeat and are made of familiar parts; a key is noise. A long string near a sensitive word is
compressed with a dictionary of common identifiers, those of the documents themselves, and the text around it. What it adds to the compressed size, for each
of its own bytes, is its novelty; a string that hardly shrinks is reported.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.columns import id_back, id_text
from rillflow.llm.tokens import batches

# The base patterns, the length that a match (of assign: its second group) needs.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

#: Strings that may be secrets, and the words that make a place sensitive.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}", re.ASCII)
SENSITIVE = re.compile(r"passw|secret|token|api.?key|private.?key|credential|auth|bearer|signature|\bkey\b", re.IGNORECASE | re.ASCII)
#: Characters before a string that are searched for a sensitive word, and on either side that prime the compressor.
REACH, AROUND = 48, 512
#: Compressed bytes that a string adds for each of its own, from which on it is reported.
NOVELTY = 0.75
#: How many identifiers prime the compressor, and in how many texts one has to be.
NAMES, TEXTS = 400, 3
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{3,31}"
# Parts of identifiers that are common everywhere, for texts that have few of their own.
COMMON = (
    "function return const static public private import export default class string number boolean undefined null "
    "password username account service client server request response handler controller configuration environment "
    "application connection database transaction authorization authentication credentials certificate signature "
    "production development test example localhost http https www com org net index main config settings version "
    "get set has is to from with by id name type value key token secret data list map array object error message "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ "
)


def _size(data: bytes, prime: bytes) -> int:
    dictionary = zstandard.ZstdCompressionDict(prime, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    settings = zstandard.ZstdCompressionParameters.from_level(19, source_size=len(data) + 1, dict_size=len(prime), format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0)
    return len(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings).compress(data))


def novelty(text: str, start: int, end: int, names: str = COMMON) -> float:
    """Compressed bytes that ``text[start:end]`` adds to what is around it and to ``names``, for each byte of it."""
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    prime = (names + after + before).encode("utf-8", "replace")
    own = text[start:end].encode("utf-8", "replace")
    return (_size(own, prime) - _size(b"", prime)) / len(own)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, by start and kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def novel_spans(text: str, base: list[tuple[int, int, int]], names: str = COMMON) -> list[tuple[int, int, int]]:
    """Incompressible strings in sensitive places that no base span touches; ``base`` is in order of starts."""
    starts = [s for s, _, _ in base]
    reach = [0]  # how far the first spans go
    for _, _, e in base:
        reach.append(max(reach[-1], e))
    out = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        own = m[0]
        if not any(c.isdigit() for c in own) or not any(c.isalpha() for c in own):
            continue
        if not SENSITIVE.search(text, max(0, a - REACH), a) or reach[bisect_left(starts, b)] > a:
            continue
        if novelty(text, a, b, names) >= NOVELTY:
            out.append((a, 3, b))
    return out


def learn_identifiers(docs: DataFrame) -> str:
    """The identifiers that most texts have, counted over all of them; the commonest last.

    At most NAMES names of at most 32 characters, each in TEXTS texts or more: a secret is in fewer. Where there are
    none the common parts stand alone.
    """
    names = docs.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0)))).alias("name"))
    counts = names.groupBy("name").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= TEXTS)
    best = counts.orderBy(F.desc("texts"), "name").limit(NAMES).collect()
    return COMMON + "".join(f"{r['name']} " for r in reversed(best))


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(frames: Iterator[pd.DataFrame], names: str) -> Iterator[pd.DataFrame]:
    for frame in batches(frames):
        rows = []
        for text in frame["text"]:
            text = text or ""
            base = base_spans(text)
            spans = sorted(base + novel_spans(text, base, names))
            counts = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
            rows.append((*counts, hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans)))
        out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])
        out.insert(0, "doc_id", frame["doc_id"].to_numpy())
        yield out


def find_secrets(docs: DataFrame, names: str = COMMON) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts by kind, base_sha256 and spans.

    Spans are ``kind:start:end`` in code points, the end exclusive, by start and then kind (assign, access, hex, novel),
    joined by commas; base_sha256 is the digest of those of the first three kinds. A null text counts as empty and has
    no spans, a null id is passed on, rows that repeat are scanned each, other columns are not read. Every text is
    scanned whole in the task that reads it, in time that grows with its length; nothing is shuffled. ``names`` primes
    the compressor, see :func:`learn_identifiers`.
    """
    fields = "doc_id string, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"
    return id_back(docs.select(id_text(), "text").mapInPandas(partial(_scan, names=names), fields))
