"""Byte-pair encoding as a streaming transducer with bounded lookahead, and its decoder.

The merge list alone fixes which two tokens can stand side by side: t, u can iff merging the symbols of both
gives back exactly t, u. A text has exactly one segmentation in which all neighbours can, and that is its
encoding. So the transducer keeps, for each place in the symbols read, the one token that would end there: the
token whose forerunner (the one that would end where it begins) can stand before it. Any later token begins at
one of the last ``longest`` places; what the chains from all those places share can no longer change and is
emitted, and what lies before is forgotten.

How far a decision can be overturned from the right follows from the merge list: a merge that consumes the
right edge of an earlier one must come before it in the list, so the longest such chain bounds the symbols to
look at (``lookahead``). The buffer never holds more than that and one longest token, whatever the text.

Decoding maps ids back to bytes and bytes to text by a state machine that keeps at most three pending bytes.

Defined results: null texts are empty ones, empty texts have no ids and decode to the empty text; repeated
rows give repeated results; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import read_table
from ._tokens import BYTE_SPELLING, WordEncoder, gather, vocabulary_path

END_OF_WORD = "</w>"
PAIRS_KEPT = 2_000_000


class MergeList:
    """What follows from a list of merges: tokens, which may be neighbours, the sufficient lookahead."""

    def __init__(self, merges: list[tuple[str, str]], vocabulary: dict[str, int]):
        self.vocabulary = vocabulary
        self.rank = {(vocabulary[a], vocabulary[b]): (k, vocabulary[a + b]) for k, (a, b) in enumerate(merges)}
        self.symbols: dict[int, tuple[int, ...]] = {}
        for spelled in BYTE_SPELLING.values():
            for symbol in (spelled, spelled + END_OF_WORD):
                self.symbols[vocabulary[symbol]] = (vocabulary[symbol],)
        for a, b in merges:
            self.symbols.setdefault(
                vocabulary[a + b], self.symbols[vocabulary[a]] + self.symbols[vocabulary[b]]
            )
        self.longest = max(map(len, self.symbols.values()))
        self.lookahead = self._lookahead(merges)
        self.neighbours: dict[tuple[int, int], bool] = {}
        self.reach: dict[int, bool] = {}
        self.backwards: dict = {}
        for token, symbols in self.symbols.items():
            node = self.backwards
            for s in reversed(symbols):
                node = node.setdefault(s, {})
            node[-1] = token

    def _lookahead(self, merges: list[tuple[str, str]]) -> int:
        """Symbols to the right that can decide about a boundary: the longest chain of merges in which each
        takes the right edge of the one after it in the list."""
        vocabulary, right = self.vocabulary, {}
        best: dict[int, int] = {}  # by left part, over the merges so far
        top = 0
        for a, b in merges:
            u, v, t = vocabulary[a], vocabulary[b], vocabulary[a + b]
            right.setdefault(t, v)
            edge, after = v, 0
            while edge is not None:  # v, its right part, that one's right part, ...
                after = max(after, best.get(edge, 0))
                edge = right.get(edge)
            reach = len(self.symbols[v]) + after
            best[u] = max(best.get(u, 0), reach)
            top = max(top, reach)
        return top

    def merge(self, symbols: Iterable[int]) -> list[int]:
        """Merging by definition: always the earliest merge of the list, leftmost first."""
        out, rank = list(symbols), self.rank
        while len(out) > 1:
            k = min(range(len(out) - 1), key=lambda i: rank.get((out[i], out[i + 1]), (1 << 60,))[0])
            found = rank.get((out[k], out[k + 1]))
            if found is None:
                break
            out[k : k + 2] = [found[1]]
        return out

    def alone(self, token: int) -> bool:
        """Whether a token's own symbols merge to it."""
        if token not in self.reach:
            self.reach[token] = self.merge(self.symbols[token]) == [token]
        return self.reach[token]

    def side_by_side(self, a: int, b: int) -> bool:
        found = self.neighbours.get((a, b))
        if found is None:
            if len(self.neighbours) >= PAIRS_KEPT:
                self.neighbours.clear()
            found = self.merge(self.symbols[a] + self.symbols[b]) == [a, b]
            self.neighbours[a, b] = found
        return found


class Transducer:
    """Symbols in, tokens out as soon as they are stable."""

    def __init__(self, merges: MergeList):
        self.merges = merges
        self.limit = merges.longest + merges.lookahead
        self.most_held = 0
        self._start()

    def _start(self) -> None:
        self.held: list[int] = []  # symbols after the last emitted token
        self.last: list[int] = []  # the token that would end after each of them

    def _ending(self) -> int:
        """The token that would end after the last symbol held."""
        held, last, m = self.held, self.last, self.merges
        node, known, place = m.backwards, m.neighbours, len(held)
        while place:
            place -= 1
            node = node.get(held[place])
            if node is None:
                break
            token = node.get(-1)
            if token is not None:
                if not place:
                    fits = self._first(token)
                elif (fits := known.get((last[place - 1], token))) is None:
                    fits = m.side_by_side(last[place - 1], token)
                if fits:
                    return token
        raise ValueError("no token ends here")

    def push(self, symbol: int) -> Iterator[int]:
        self.held.append(symbol)
        self.last.append(self._ending())
        self.most_held = max(self.most_held, len(self.held))
        if len(self.held) > self.limit:
            yield from self._stable()

    def _first(self, token: int) -> bool:
        before = getattr(self, "emitted", None)
        return self.merges.alone(token) if before is None else self.merges.side_by_side(before, token)

    def _chain(self, end: int) -> list[int]:
        ends = []
        while end:
            ends.append(end)
            end -= len(self.merges.symbols[self.last[end - 1]])
        return ends

    def _stable(self) -> Iterator[int]:
        n = len(self.held)
        shared = set.intersection(*(set(self._chain(e)) for e in range(n - self.merges.longest + 1, n + 1)))
        if not shared:
            return
        upto = max(shared)
        yield from self._emit(upto)

    def _emit(self, upto: int) -> list[int]:
        out = [self.last[e - 1] for e in reversed(self._chain(upto))]
        del self.held[:upto], self.last[:upto]
        if out:
            self.emitted = out[-1]
        return out

    def finish(self) -> list[int]:
        """The tokens not yet emitted; the next symbol begins a new word."""
        out = self._emit(len(self.held)) if self.held else []
        self._start()
        self.emitted = None
        return out

    def word(self, symbols: list[int]) -> list[int]:
        out: list[int] = []
        self.emitted = None
        if len(symbols) <= self.limit:  # nothing is emitted before the end
            for s in symbols:
                self.held.append(s)
                self.last.append(self._ending())
        else:
            for s in symbols:
                out.extend(self.push(s))
        return out + self.finish()


PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")


class Codec(WordEncoder):
    """Encoder and decoder of one vocabulary file, by the transducer."""

    def __init__(self, path: str, memo_words: int = 300_000):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        vocabulary = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in file["added_tokens"] if t["special"]}
        self.merges = MergeList([tuple(m) for m in model["merges"]], vocabulary)
        self.transducer = Transducer(self.merges)
        self.inner = {b: vocabulary[s] for b, s in BYTE_SPELLING.items()}
        self.final = {b: vocabulary[s + END_OF_WORD] for b, s in BYTE_SPELLING.items()}
        self.spelled = {i: t.encode() for t, i in (vocabulary | self.special).items()}
        marks = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
        self.marks = regex.compile(f"({marks})") if marks else None
        self.memo, self.old, self.memo_words = {}, {}, memo_words

    def _piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "replace")
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.final[raw[-1]]
        return self.transducer.word(symbols)

    def ids(self, text: str) -> list[int]:
        """The ids of any text: special tokens as they stand; the rest normalised (NFC, lower case letter by
        letter), split into pieces, and each piece through the transducer."""
        out: list[int] = []
        for part in self.marks.split(text) if self.marks else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                plain = unicodedata.normalize("NFC", part)
                low = "".join(map(str.lower, plain)) if "Σ" in plain else plain.lower()
                for piece in PIECES.findall(low):
                    out.extend(self._piece(piece))
        return out

    def _one_piece(self, words: list[str]) -> list[bytes]:
        return [np.array(self._piece(w), "<u4").tobytes() for w in words]

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(self.ids(w), "<u4").tobytes() for w in words]

    def spell(self, ids: Iterable[int]) -> bytes:
        """Tokens as they are spelled, one space between: what decoding gives where a vocabulary names no
        decoder of its own."""
        return b" ".join(map(self.spelled.__getitem__, ids))


class ByteToText:
    """UTF-8 bytes in, text out, as they come: never more than three bytes wait.

    Bytes that cannot belong to a character become U+FFFD, as the maximal ill-formed part.
    """

    #: first byte from, to; lowest and highest second byte; bytes that follow the first
    _FIRST = (
        (0xC2, 0xDF, 0x80, 0xBF, 1),
        (0xE0, 0xE0, 0xA0, 0xBF, 2),
        (0xE1, 0xEC, 0x80, 0xBF, 2),
        (0xED, 0xED, 0x80, 0x9F, 2),
        (0xEE, 0xEF, 0x80, 0xBF, 2),
        (0xF0, 0xF0, 0x90, 0xBF, 3),
        (0xF1, 0xF3, 0x80, 0xBF, 3),
        (0xF4, 0xF4, 0x80, 0x8F, 3),
    )

    def __init__(self) -> None:
        self.waiting, self.need, self.low, self.high = b"", 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        if not self.waiting and data.isascii():
            return data.decode("ascii")
        out = []
        for b in data:
            if self.need:
                if self.low <= b <= self.high:
                    self.waiting += bytes((b,))
                    self.need -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.need:
                        out.append(self.waiting.decode())
                        self.waiting = b""
                    continue
                out.append(self.finish())
            if b < 0x80:
                out.append(chr(b))
                continue
            for first, last, low, high, more in self._FIRST:
                if first <= b <= last:
                    self.waiting, self.need, self.low, self.high = bytes((b,)), more, low, high
                    break
            else:
                out.append("�")
        return "".join(out)

    def finish(self) -> str:
        out = "�" if self.waiting else ""
        self.waiting, self.need, self.low, self.high = b"", 0, 0x80, 0xBF
        return out


def decoded(codec: Codec, ids: Iterable[int]) -> Iterator[str]:
    """The text of ids, piece by piece."""
    machine, first = ByteToText(), True
    for i in ids:
        yield machine.feed(codec.spelled[i] if first else b" " + codec.spelled[i])
        first = False
    yield machine.finish()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): each text's ids as little-endian unsigned 32-bit integers."""
    path = path or vocabulary_path()

    def run(batches):
        for batch in batches:
            rows = []
            for found, index, bounds in codec(path).pieces(batch.column(1)):
                ids, at = gather(found, index)
                raw, cuts = memoryview(ids).cast("B") if len(ids) else memoryview(b""), (4 * at[bounds]).tolist()
                rows += [bytes(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, ids binary"
    )


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, from one pass over its text."""
    path = path or vocabulary_path()

    def run(batches):
        for batch in batches:
            own, sizes, coded, texts = codec(path), [], [], []
            for found, index, bounds in own.pieces(batch.column(1)):
                ids, at = gather(found, index)
                raw, cuts = memoryview(ids).cast("B") if len(ids) else memoryview(b""), (4 * at[bounds]).tolist()
                spelled = ["".join(decoded(own, np.frombuffer(x, "<u4").tolist())).encode() for x in found]
                if not all(found):  # pieces without ids leave no space behind
                    keep = np.array([bool(x) for x in found])[index]
                    kept = np.concatenate([[0], np.cumsum(keep)])
                    index, bounds = index[keep], kept[bounds]
                places = index.tolist()
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    sizes.append((b - a) // 4)
                    coded.append(hashlib.sha256(raw[a:b]).hexdigest())
                    words = map(spelled.__getitem__, places[bounds[k] : bounds[k + 1]])
                    texts.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(coded, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"))


QUERIES = {"op3_bpe": op3_bpe}
ORACLES: dict[str, str] = {}
