"""Whole texts to token ids with the tokenizers library, through a bounded memo of words.

The tokenizer at hand drops white space and never merges across it, so the ids of a text are those of its
white-space separated words in turn. Arrow splits a slice of texts and finds its distinct words; each is
encoded by the library once and then remembered. The memo has two generations of at most ``MEMO_WORDS`` words
(or one slice's), so memory stays bounded whatever the corpus.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._arrow import give_back, slices, text_bytes

MEMO_WORDS = 400_000
SLICE_BYTES = 4 << 20
VOCABULARY = "word_bpe_49k.json"
#: Words that are one piece for the tokenizer.
LETTERS = re.compile("[a-zà-öø-ÿ]+")
#: How the byte-level vocabulary spells those beyond ASCII: each byte from 0xA1 on but 0xAD by its code point,
#: the unprintable ones by code points from 256 on.
_HIDDEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE)]
BYTE_SPELLING = {b: chr(256 + _HIDDEN.index(b)) if b in _HIDDEN else chr(b) for b in range(256)}
SPELLED = {c: "".join(BYTE_SPELLING[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}
ALNUM = np.zeros(256, bool)
ALNUM[[c for c in range(128) if chr(c).isalnum()]] = True


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Texts to unsigned 32-bit ids."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # the generation before
        self.memo_words = memo_words

    def _each(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _one_piece(self, words: list[str]) -> list[bytes]:
        """Words that are one lower-case piece each go to the library's BPE model at once, spelled as it
        spells bytes; normalising and splitting would not change them."""
        tokenize = self.tokenizer.model.tokenize
        return [array("I", [t.id for t in tokenize(w if w.isascii() else w.translate(SPELLED))]).tobytes() for w in words]

    def words(self, distinct: list[str]) -> list[bytes]:
        """The ids of each of some distinct words."""
        memo = self.memo
        found = list(map(memo.get, distinct))
        missing = [w for w, x in zip(distinct, found, strict=True) if x is None]
        if missing:
            found = [self.old.get(w) if x is None else x for w, x in zip(distinct, found, strict=True)]
            missing = [w for w, x in zip(distinct, found, strict=True) if x is None]
            if len(memo) + len(distinct) > self.memo_words:
                self.old, self.memo = memo, {}
                memo = self.memo
            memo.update(zip(distinct, found, strict=True))
            whole = [w for w in missing if not LETTERS.fullmatch(w)]
            letters = list(set(missing).difference(whole))
            memo.update(zip(letters, self._one_piece(letters), strict=True))
            memo.update(zip(whole, self._each(whole), strict=True))
            found = [memo[w] if x is None else x for w, x in zip(distinct, found, strict=True)]
        return found

    def pieces(self, texts: pa.Array) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
        """For each slice of rows: the ids of its distinct pieces, which piece stands where, the n + 1 offsets
        of each row among those."""
        _, offsets = text_bytes(texts)
        for a, b in slices(offsets, SLICE_BYTES):
            lists = pc.ascii_split_whitespace(texts.slice(a, b - a).fill_null("").cast(pa.large_string()))
            words = lists.flatten()
            ended = ends_in_point(words)
            stems = pc.if_else(pa.array(ended), pc.utf8_slice_codeunits(words, 0, -1), words)
            if not pc.any(pc.match_substring(words, "<|")).as_py():  # no special token that case would make
                stems = pc.ascii_lower(stems)
            coded = pc.dictionary_encode(stems)
            distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            bounds = lists.offsets.to_numpy()
            if ended.any():  # the point or comma follows its word as a piece of its own
                index, bounds = self._with_points(words, ended, index, bounds - bounds[0], len(distinct))
            yield [*self.words(distinct), *self.words([".", ","])], index, bounds - bounds[0]

    @staticmethod
    def _with_points(words, ended, index, bounds, n):
        data, offsets = text_bytes(words)
        last = data[offsets[1:][ended] - 1]
        before = np.zeros(len(index) + 1, np.int64)
        np.cumsum(ended, out=before[1:])
        out = np.empty(len(index) + before[-1], np.int64)
        place = np.arange(len(index)) + before[:-1]
        out[place] = index
        out[place[ended] + 1] = np.where(last == ord("."), n, n + 1)
        return out, bounds + before[bounds]


def ends_in_point(words: pa.Array) -> np.ndarray:
    """Which words are something that ends in a letter or digit, then one point or comma. The tokenizer
    makes two pieces there. Only ASCII and the two-byte Latin letters U+00C0 to U+00FF count as letters here."""
    data, offsets = text_bytes(words)
    a, z = offsets[:-1], offsets[1:]
    if not len(a) or not len(data):
        return np.zeros(len(a), bool)
    last, prev, first = data[np.maximum(z - 1, 0)], data[np.maximum(z - 2, 0)], data[np.maximum(z - 3, 0)]
    plain = ALNUM[prev]
    latin = (first == 0xC3) & (prev >= 0x80) & (prev != 0x97) & (prev != 0xB7) & (z - a >= 3)
    return ((last == ord(".")) | (last == ord(","))) & (z - a >= 2) & (plain | latin)


def gather(found: list[bytes], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of ``found[index[0]], found[index[1]], ...`` and the len(index) + 1 offsets of each."""
    all_ids = np.frombuffer(b"".join(found), dtype="<u4")
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    starts = np.cumsum(sizes) - sizes
    taken = sizes[index]
    at = np.zeros(len(index) + 1, np.int64)
    np.cumsum(taken, out=at[1:])
    return all_ids[np.repeat(starts[index] - at[:-1], taken) + np.arange(at[-1])], at


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encoded_rows(path: str, texts: pa.Array, end: int | None = None) -> Iterator[bytes]:
    """Little-endian unsigned 32-bit ids of each text in turn, with ``end`` after each."""
    tail = b"" if end is None else end.to_bytes(4, "little")
    for found, index, bounds in encoder(path).pieces(texts):
        ids, at = gather(found, index)
        raw = memoryview(ids).cast("B") if len(ids) else memoryview(b"")
        cuts = (4 * at[bounds]).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield bytes(raw[a:b]) + tail
        del found, index, bounds, ids, at, raw
        give_back()
