"""Words of a text in a form that survives case, punctuation, spacing, wrapping and look-alike characters."""

from __future__ import annotations

import re
import unicodedata

# Letters of other alphabets that look like Latin ones.
LOOKALIKES = str.maketrans({
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ո": "n",
    "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "υ": "u", "ν": "v", "ι": "i", "κ": "k",
    "τ": "t", "ı": "i", "ℓ": "l", "’": "'", "ʼ": "'",
})
_HIDDEN = re.compile("[­​‌‍⁠﻿]")
_WRAPPED = re.compile(r"(?<=[^\W\d_])[-‐‑¬]\s*\n\s*(?=[^\W\d_])")
_COMMAS = re.compile(r"(?<=\d),(?=\d{2,3}(?:\D|$)|\d{2},)")
_WORD = re.compile(r"\d+(?:\.\d+)?|[^\W\d_]+(?:[̀-ͯऀ-ॿ]+[^\W\d_]*)*")


def words(text: str | None) -> list[str]:
    """Empty for NULL and for texts without letters or digits."""
    if not text:
        return []
    s = _HIDDEN.sub("", text)
    s = _WRAPPED.sub("", s)
    if not s.isascii():
        s = unicodedata.normalize("NFKD", s).lower().translate(LOOKALIKES)
        s = re.sub("[̀-ͯ]", "", s)
    else:
        s = s.lower()
    return _WORD.findall(_COMMAS.sub("", s))
