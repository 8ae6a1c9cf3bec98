"""Token ids of whole texts by a public word-level BPE, with a cache of words.

Texts are cut at spaces and line ends, which the tokenizer's own pattern never
joins, so a text's ids are those of its words one after another. A word seen
before costs one dictionary look-up. A new word of printable Latin-1 characters
is cut into the tokenizer's pieces here and only unseen pieces go through its
BPE model; any other word goes through the tokenizer as a whole. Both give the
ids that the library gives for the whole text.

Texts without special tokens or code points that NFC could join or that have no
simple lower case are first lower-cased, and marks at a word's end cut off: a run
of marks between a letter and white space is one piece of the tokenizer's
pattern. That leaves fewer distinct words.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The pattern of the tokenizer file, and the byte alphabet of byte-level BPE.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PLAIN = regex.compile(r"[\x21-\x7e\xa1-\xac\xae-\xff]*")
SPECIAL = "<|"
ODD = r"<\||\x{130}|[\x{300}-\x{1FFF}\x{20D0}-\x{10FFFF}]"  # special tokens, the dotted I, combining marks and whatever else isn't Latin or a mark
END_MARKS = r"([a-z])([!-&(-/:-=?@\[-`{-~]+)([ \n]|$)"  # not the apostrophe, which contractions have, nor >, which ends special tokens

LIMIT = 300_000  # words kept at some 200 bytes each; pieces: half as many
SLICE_ROWS, SLICE_BYTES = 512, 2 << 20  # what a call should bring at most: its copies of the texts and their word numbers take some 20 times that

_ENCODERS: dict[tuple[str, int], "WordEncoder"] = {}


def byte_alphabet() -> dict[int, str]:
    """Printable Latin-1 bytes stand for themselves; the rest for the code points from 256 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(others)) for b in range(256)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str, limit: int = LIMIT) -> "WordEncoder":
    """The worker's encoder; tasks that follow on the same worker find its cache filled."""
    if (path, limit) not in _ENCODERS:
        _ENCODERS[path, limit] = WordEncoder(path, limit)
    return _ENCODERS[path, limit]


class WordEncoder:
    """limit: the most words that are kept; beyond it the cache starts anew, and that of pieces beyond half of it."""

    def __init__(self, path: str, limit: int = LIMIT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.alphabet = byte_alphabet()
        self.limit = limit
        self.pieces: dict[str, array] = {}
        self._forget_words()

    def _forget_words(self) -> None:
        self.words: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int32)
        self.length = np.zeros(1 << 14, np.int32)

    def _piece(self, piece: str) -> array:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.pieces[piece] = self._spelled(piece)
        return ids

    def _spelled(self, piece: str) -> array:
        """The ids of a lower-case piece of printable Latin-1."""
        spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(spelled)])

    def _word(self, word: str) -> array:
        """The word's ids. ASCII control characters and everything beyond Latin-1 are left to the library."""
        if word.isascii() and word.isalpha() and word.islower():
            return self._spelled(word)
        if SPECIAL in word or not PLAIN.fullmatch(word):
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids)
        low = word.lower()
        if low.isalpha():
            return self._piece(low)
        ids = array("I")
        for piece in PIECES.findall(low):
            ids += self._piece(piece)
        return ids

    def _learn(self, words: list[str]) -> None:
        if len(self.words) + len(words) > len(self.start):
            size = 3 * (len(self.words) + len(words)) // 2
            self.start, self.length = np.resize(self.start, size), np.resize(self.length, size)
        found = [self._word(word) for word in words]
        more = sum(map(len, found))
        if self.used + more > len(self.flat):
            self.flat = np.resize(self.flat, 3 * (self.used + more) // 2)
        at, lengths = len(self.words), np.fromiter(map(len, found), np.int64, len(found))
        joined = array("I")
        for ids in found:
            joined += ids
        self.flat[self.used : self.used + more] = joined
        self.start[at : at + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.length[at : at + len(words)] = lengths
        self.words.update(zip(words, range(at, at + len(words)), strict=True))
        self.used += more

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one uint32 array, and where each text ends in it. Null counts as empty.

        Arrow splits the texts and numbers their distinct words, so a word costs
        Python work once for each call.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        plain = pc.replace_substring_regex(pc.utf8_lower(texts), END_MARKS, r"\1 \2\3")
        texts = pc.if_else(pc.match_substring_regex(texts, ODD), texts, plain)
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > self.limit:
            self._forget_words()
            if len(self.pieces) > self.limit // 2:
                self.pieces = {}
            new = words
        self._learn(new)
        own = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        at = own[coded.indices.to_numpy()]
        length = self.length[at]
        ends = np.cumsum(length, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.start[at] - (ends - length), length) + np.arange(total)]
        counts = pc.list_value_length(cut).to_numpy()
        return ids, ends[np.cumsum(counts) - 1] if len(counts) else ends

    def encode(self, texts: pa.Array | list, end_id: int | None = None) -> list[np.ndarray]:
        """A uint32 array for each text, with end_id after it if that is given."""
        ids, ends = self.encode_column(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        if not len(ends):
            return []
        begins = [0, *ends[:-1].tolist()]
        if end_id is None:
            return [ids[b:e] for b, e in zip(begins, ends.tolist(), strict=True)]
        places = ends + np.arange(len(ends))
        out = np.full(len(ids) + len(ends), end_id, np.uint32)
        kept = np.ones(len(out), bool)
        kept[places] = False
        out[kept] = ids
        return [out[b + k : e + 1] for k, (b, e) in enumerate(zip(begins, places.tolist(), strict=True))]
