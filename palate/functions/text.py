"""Names and queries as folded text, and how well one matches the other.

Plain functions of one string, and their Arrow-batched forms for columns (``column``). White space is the set that
scripts in browsers know, spelled out, because engines differ.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

SPACES = "\t\n\v\f\r    -     　﻿"
_SPACE = re.compile(f"[{SPACES}]+")
LONGEST = 128
# Letters of other scripts (by code point) that look like Latin ones.
LOOKALIKES = {
    0x0430: "a",
    0x0435: "e",
    0x043E: "o",
    0x0440: "p",
    0x0441: "c",
    0x0443: "y",
    0x0445: "x",
    0x0456: "i",
    0x0458: "j",
    0x0455: "s",
    0x04BB: "h",
    0x03BF: "o",
    0x03B1: "a",
    0x03B5: "e",
    0x03B9: "i",
    0x03BA: "k",
    0x03BD: "v",
    0x03C1: "p",
    0x03C4: "t",
    0x03C5: "u",
    0x03C7: "x",
    0x03F2: "c",
}


def collapse(text: str) -> str:
    return _SPACE.sub(" ", text).strip(" ")


def fold_id(text: str) -> str:
    """Lower case, compatibility form, single spaces, trimmed; in that order."""
    return collapse(unicodedata.normalize("NFKC", text.lower()))


def search_fold(text: str) -> str:
    """Without marks and punctuation (symbols stay), single spaces, composed."""
    apart = unicodedata.normalize("NFD", text)
    return unicodedata.normalize("NFC", collapse("".join(c for c in apart if unicodedata.category(c)[0] not in "MP")))


def fold_query(text: str) -> str:
    return search_fold(unicodedata.normalize("NFKC", text.lower()))


def skeleton(text: str) -> str:
    """What a name looks like: folded, look-alike letters as Latin ones."""
    return search_fold(text).translate(LOOKALIKES)


def script(c: str) -> str | None:
    """A letter's script by its character name; marks, digits, signs and spaces belong to any."""
    if unicodedata.category(c)[0] != "L":
        return None
    word = unicodedata.name(c, "?").split(" ")[0]
    return {"HIRAGANA": "KANA", "KATAKANA": "KANA", "CJK": "HAN", "IDEOGRAPHIC": "HAN", "FULLWIDTH": "LATIN"}.get(word, word)


_TOGETHER = ({"HAN", "KANA", "LATIN"}, {"HAN", "HANGUL", "LATIN"}, {"HAN", "BOPOMOFO", "LATIN"})


def _scripts_agree(word: str) -> bool:
    found = {s for s in map(script, word) if s}
    if len(found) <= 1 or any(found <= t for t in _TOGETHER):
        return True
    return len(found) == 2 and "LATIN" in found and not found & {"CYRILLIC", "GREEK"}


def is_normalized(text: str) -> bool:
    """Whether a text may be a name as it stands."""
    if not 1 <= len(text) <= LONGEST or text != fold_id(text):
        return False
    marks, before = 0, ""
    for k, c in enumerate(text):
        kind = unicodedata.category(c)
        if kind in ("Cc", "Cs", "Co", "Cn", "Zl", "Zp") or kind == "Cf" and c not in "‌‍":
            return False
        if c in "‌‍" and (k in (0, len(text) - 1) or unicodedata.category(before)[0] not in "LM"):
            return False
        if kind[0] == "M":
            marks += 1
            if not before or before == " " or marks > 4 or c == before:
                return False
        else:
            marks = 0
        before = c
    words = text.split(" ")
    return not any(w[0] in "!#@" for w in words) and all(map(_scripts_agree, words))


def normalize_id(text: str) -> str | None:
    """The name a text stands for, or None where it can be none; never cut short."""
    folded = fold_id(text)
    return folded if is_normalized(folded) else None


def parse_query(text: str) -> list[dict]:
    """The words of a query: ``!`` wants little of it, ``@`` looks at names, ``#`` at attributes."""
    out = []
    for raw in collapse(unicodedata.normalize("NFKC", text)).split(" "):
        word, low, field = raw, False, None
        if word.startswith("!"):
            word, low = word[1:], True
        if word.startswith("@"):
            word, field = word[1:], "name"
        if word.startswith("#"):
            word, field = word[1:], "attribute"
        folded = fold_query(word)
        if folded:
            out.append({"text": folded, "raw": raw, "low": low, "field": field})
    return out


def typo_budget(length: int) -> int:
    return 0 if length <= 3 else 1 if length <= 6 else 2


def prefix_distance(word: str, target: str, limit: int, offset: int = 0) -> int:
    """Insertions, deletions, changes and swaps of neighbours between ``word`` and the best prefix of
    ``target[offset:]``; ``limit + 1`` for anything above the limit."""
    text = target[offset : offset + len(word) + limit]
    two: list[int] = []
    one = list(range(len(text) + 1))
    for i, c in enumerate(word, 1):
        row = [i]
        for j, t in enumerate(text, 1):
            cost = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (c != t))
            if i > 1 and j > 1 and c == text[j - 2] and word[i - 2] == t:
                cost = min(cost, two[j - 2] + 1)
            row.append(cost)
        if min(row) > limit:
            return limit + 1
        two, one = one, row
    return min(min(one), limit + 1)


def match_term(term: str, candidate: str, loose: bool = True, typos: bool = True, whole: bool = False) -> tuple[str, float] | None:
    """How a folded term matches a folded candidate: (tier, weight), or None.

    Exact and prefix matches at word starts first; then matches within the typo budget; then, for terms of four
    letters or more, letters in order.
    """
    if not term:
        return "exact", 1.0
    size = len(term)
    starts = [0, *(k + 1 for k, c in enumerate(candidate) if c == " ")]

    def weight(length: int, start: int, end: int) -> float:
        stop = candidate.find(" ", max(end, start))
        stop = len(candidate) if stop < 0 else stop
        return length / max(size, len(candidate) if whole else stop - start)

    best = None
    for s in starts:
        if candidate.startswith(term, s):
            end = s + size
            tier = "exact" if end == len(candidate) or candidate[end] == " " else "prefix"
            w = weight(size, s, end)
            if best is None or w > best[1]:
                best = (tier, w)
    if best:
        return best
    budget = typo_budget(size)
    if typos and budget:
        for s in starts:
            e = prefix_distance(term, candidate, budget, s)
            if e <= budget:
                w = weight(size - e, s, min(len(candidate), s + size - 1))
                if best is None or w > best[1]:
                    best = ("typo", w)
        if best:
            return best
    if loose and size >= 4:
        letters = iter(candidate)
        if all(c in letters for c in term):
            return "subsequence", size / len(candidate)
    return None


def initials(name: str) -> str:
    """Up to two first letters, of one script."""
    found = [w[0].upper() for w in collapse(name).split(" ") if w and w[0].isalpha()]
    picked = found[:1] + [c for c in found[-1:] if len(found) > 1 and script(c) == script(found[0])]
    return "".join(picked)


def column(function: Callable[[str], str | None]):
    """A function of one string as a function of a string column; nulls stay null."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else function(v))

    return run
