"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

A vocabulary learned from text spells words in few tokens and random strings in
many. Runs of a key alphabet are encoded by a tiktoken vocabulary; fewer than
`most_ratio` characters per token mark a secret. Runs of 20 or more characters
that mix letters and digits are scored whole, unless the run is a known digest or
identifier: hex of a digest's length, a UUID, a number, a date, words joined by
marks, a path. What that leaves is scored by its words, the pieces between marks:
neighbouring words of 16 or more characters together that take more tokens than
the ratio allows are a secret, whatever stands before or after them in the run.
Digests, UUIDs and numbers don't count there, nor do words of one or two
characters, which any vocabulary has.

Defined results: a null text is empty; overlapping spans of different kinds are
all reported; repeated rows get equal answers; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, prepare, slices, text_or_empty

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_WORDS = ("passw", "secret", "token", "api")  # a text without any of these has no match
LEAST_VALUE = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # of 18 characters or more: the same matches as the open pattern, then the length test
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")

KNOWN = re.compile(
    r"[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"
    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    r"|[0-9+/_=-]+"
    r"|(?:[A-Za-z]+[0-9]{0,4}[/_=+-]+)*[A-Za-z]+[0-9]{0,4}=*"
)
MOST_RATIO = 2.2
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
WHOLE = 20
LEAST = 16
#: A known digest or UUID within a run, or a word that tells something.
PIECE = re.compile(r"(?<![A-Za-z0-9])(?:([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|[0-9]{8}T[0-9]{6}Z?)|(?![0-9]+(?![A-Za-z0-9]))[A-Za-z0-9]{3,})(?![A-Za-z0-9])")
LEAST_DISTINCT = 6  # characters; a random string of LEAST has more, a filler has fewer
LONG = 256  # a word is encoded in slices of so many characters, since encoding grows faster than a word

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_random", pa.int64())])
_ENCODINGS: dict = {}


def encoding(path: str | None = None):
    """The tiktoken encoding of a rank file; the public byte-level vocabulary unless a path is given."""
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _ENCODINGS:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def random_words(run: str, enc, most_ratio: float) -> list[tuple[int, int]]:
    """Start and end of neighbouring words in a run that together take more tokens than most_ratio allows."""
    words = []  # start, end, tokens' worth less characters: above 0 if random
    for m in PIECE.finditer(run):
        word = m[0]
        tokens = sum(len(enc.encode_ordinary(word[at : at + LONG])) for at in range(0, len(word), LONG))
        words.append((*m.span(), float("-inf") if m[1] else most_ratio * tokens - len(word)))
    found, at = [], 0
    while at < len(words):
        total, best, end = 0.0, 0.0, None
        for i in range(at, len(words)):
            total += words[i][2]
            if total <= 0:
                break
            if total > best:
                best, end = total, i
        if end is None:
            at += 1
            continue
        start, stop = words[at][0], words[end][1]
        if stop - start >= LEAST and len(set(run[start:stop])) >= LEAST_DISTINCT:
            found.append((start, stop))
        at = end + 1
    return found


def random_spans(text: str, enc, most_ratio: float = MOST_RATIO) -> list[tuple[str, int, int]]:
    found = []
    for m in RUN.finditer(text):
        run, start = m[0], m.start()
        if len(run) >= WHOLE and any(c.isdigit() for c in run) and any(c.isalpha() for c in run) and not KNOWN.fullmatch(run) and len(run) < most_ratio * len(enc.encode_ordinary(run)):
            found.append(("random", *m.span()))
        else:
            found += [("random", start + a, start + b) for a, b in random_words(run, enc, most_ratio)]
    return found


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan(docs: DataFrame, vocabulary: str | None = None, most_ratio: float = MOST_RATIO) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for each row of docs."""
    prepare(docs.sparkSession)

    def run(batches):
        enc = encoding(vocabulary)
        for batch in slices(batches):
            rows = {name: [] for name in SCHEMA.names}
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                base, more = base_spans(text), random_spans(text, enc, most_ratio)
                kinds = [s[0] for s in base]
                values = (doc, *map(kinds.count, KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))), len(more))
                for name, value in zip(SCHEMA.names, values, strict=True):
                    rows[name].append(value)
            yield arrow_batch(rows, SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")
