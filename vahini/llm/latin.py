"""Plain-Python text helpers for Arrow UDFs: Devanagari to Latin letters and phonetic folding of typed names."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# The Latin spelling of Devanagari letters; a consonant carries the vowel a unless a sign follows.
_CONSONANTS = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "n", "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "n", "ट": "t", "ठ": "th",
    "ड": "d", "ढ": "dh", "ण": "n", "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n", "प": "p", "फ": "ph", "ब": "b", "भ": "bh",
    "म": "m", "य": "y", "र": "r", "ल": "l", "ळ": "l", "व": "v", "श": "sh", "ष": "sh", "स": "s", "ह": "h",
}
_VOWELS = {
    "अ": "a", "आ": "a", "इ": "i", "ई": "i", "उ": "u", "ऊ": "u", "ऋ": "ru", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au", "ऑ": "o",
}
_SIGNS = {"ा": "a", "ि": "i", "ी": "i", "ु": "u", "ू": "u", "ृ": "ru", "े": "e", "ै": "ai", "ो": "o", "ौ": "au", "ॉ": "o", "ॅ": "e"}
_DIGITS = {d: str(i) for i, d in enumerate("०१२३४५६७८९")}
_LABIALS = frozenset("पफबभम")
_FOLDS = (("ee", "i"), ("oo", "u"), ("aa", "a"), ("ii", "i"), ("uu", "u"), ("au", "o"), ("ou", "o"), ("ai", "e"), ("ay", "e"), ("w", "v"), ("z", "j"), ("ck", "k"))


def romanise(text: str) -> str:
    """Devanagari letters and digits in Latin letters; everything else as it is. The last vowel a of a word is silent."""
    if text.isascii():
        return text
    out: list[str] = []
    n = len(text)
    for i, ch in enumerate(text):
        after = text[i + 1] if i + 1 < n else ""
        if ch in _CONSONANTS:
            out.append(_CONSONANTS[ch])
            if after not in _SIGNS and after != "्" and after not in ("़",):
                if after and (after in _CONSONANTS or after in _VOWELS or after in ("ं", "ः", "ँ")):
                    out.append("a")
        elif ch in _VOWELS:
            out.append(_VOWELS[ch])
        elif ch in _SIGNS:
            out.append(_SIGNS[ch])
        elif ch in ("ं", "ँ"):
            out.append("m" if after in _LABIALS else "n")
        elif ch in _DIGITS:
            out.append(_DIGITS[ch])
        elif ch not in ("्", "ः", "़", "‍", "‌"):
            out.append(ch)
    return "".join(out)


@lru_cache(200_000)
def fold(word: str) -> str:
    """A spelling class: lower-case Latin letters and digits, long vowels short, doubled letters single."""
    s = unicodedata.normalize("NFKD", romanise(unicodedata.normalize("NFC", word)).lower())
    s = re.sub(r"[^a-z0-9]", "", s)
    s = re.sub(r"(.)\1{2,}", r"\1\1", s)
    for a, b in _FOLDS:
        s = s.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", s)


def osa(a: str, b: str, most: int) -> int:
    """Edits (a swap of neighbours is one) between two words; ``most + 1`` where there are more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    before2: list[int] = []
    before = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, cb in enumerate(b, 1):
            x = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (ca != cb))
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb and before2[j - 2] + 1 < x:
                x = before2[j - 2] + 1
            row[j] = x
        if min(row) > most:
            return most + 1
        before2, before = before, row
    return min(before[-1], most + 1)


def deletes(word: str, most: int) -> set[str]:
    """The word and everything left when up to ``most`` letters are taken out: two words within ``most`` edits share one."""
    out = level = {word}
    for _ in range(most):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out = out | level
    return out
