"""Parts of a work's title: place, which of two villages of a name, kind of work, phase."""

from __future__ import annotations

import re
from functools import lru_cache

from vahini.llm.latin import fold, romanise

# How each kind of work is named, longest names first within a kind.
KINDS = {
    "water": ("water supply scheme", "w s scheme", "ws scheme", "wss", "piped water scheme", "drinking water works", "drinking water scheme", "पाणीपुरवठा योजना", "पाणीपुरवठा", "पाणी पुरवठा योजना"),
    "sewer": ("underground sewerage scheme", "underground sewerage", "ugd scheme", "ugd", "sewer network", "sewerage scheme", "भुयारी गटार योजना", "भुयारी गटार"),
    "treatment": ("sewage treatment plant", "stp works", "s t p", "stp", "मलनिस्सारण प्रकल्प"),
    "gutter": ("r c c side gutter", "rcc side gutter", "rcc gutter", "side gutter", "गटार बांधकाम", "गटार"),
    "storm": ("storm water drain", "rain water drain", "s w drain", "sw drain", "पावसाळी नाला"),
    "tank": ("percolation tank", "perc tank", "पाझर तलाव"),
    "canal": ("lift irrigation canal", "lis canal", "उपसा सिंचन कालवा"),
    "weir": ("k t bandhara", "kt bandhara", "bandhara", "बंधारा"),
    "road": ("cement concrete road", "cc road", "approach road", "link road", "internal roads", "internal lanes", "काँक्रीट रस्ता", "जोड रस्ता", "अंतर्गत रस्ते"),
    "school": ("z p school", "school building", "शाळा इमारत"),
    "health": ("health sub centre", "आरोग्य उपकेंद्र"),
    "nursery": ("anganwadi building", "अंगणवाडी इमारत"),
    "hall": ("community hall", "samaj mandir", "समाज मंदिर"),
    "light": ("solar street lights", "solar lamps", "led street lighting", "led lamps", "street lights", "सौर पथदिवे", "पथदिवे"),
}
# What surrounds a place in a title.
_BEFORE = re.compile(r"\b(?:at|of|for|village|in)\s+(?:village\s+)?", re.IGNORECASE)
_TALUKA = re.compile(r"[,(]?\s*\b(?:tal|taluka|tq|ta|dist|district)\b\.?[\s-].*$", re.IGNORECASE)
_PHASE = re.compile(r"\(?\s*(?:\bphase|\bph|\bstage|टप्पा)\s*[-.]?\s*(iii|ii|iv|i|[1-9]|[१-९])\b\s*\)?", re.IGNORECASE)
_UPPER = re.compile(r"\(?(?<!\w)(?:bk|budruk|bu|बुद्रुक|बु)(?![\wऀ-ॿ])\.?\)?", re.IGNORECASE)
_LOWER = re.compile(r"\(?(?<!\w)(?:kh|khurd|खुर्द|खु)(?![\wऀ-ॿ])\.?\)?", re.IGNORECASE)
_ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4}
_DEVANAGARI = re.compile("[ऀ-ॿ]")


def _clean(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[^\wऀ-ॿ]+", " ", text.lower())).strip()


@lru_cache(100_000)
def bare(name: str) -> str:
    """A folded name without the vowel a, so that Marathi and English spellings agree."""
    return re.sub(r"(.)\1+", r"\1", fold(name).replace("a", ""))


def phase(text: str) -> int:
    """0 where none is named."""
    m = _PHASE.search(text)
    if not m:
        return 0
    p = m.group(1).lower()
    return _ROMAN.get(p) or int(romanise(p))


def side(text: str) -> str:
    return "u" if _UPPER.search(text) else "l" if _LOWER.search(text) else ""


def kind(text: str) -> tuple[str, str]:
    """(kind, the name it has in the text), the longest name that occurs."""
    s = f" {_clean(text)} "
    found = [(len(n), k, n) for k, names in KINDS.items() for n in names if f" {n} " in s]
    return max(found)[1:] if found else ("", "")


def village(name: str) -> str:
    """The place's name alone, bare."""
    s = re.sub(r"^\s*(gram panchayat|grampanchayat|gp|ग्रामपंचायत|municipal council|nagar panchayat)\s+", "", name, flags=re.IGNORECASE)
    s = _LOWER.sub(" ", _UPPER.sub(" ", _PHASE.sub(" ", _TALUKA.sub("", s))))
    return bare("".join(w for w in re.findall(r"[\wऀ-ॿ]+", s)))


def _named(tail: str) -> str:
    """The place in what follows the last preposition: before a comma ("at Tokide, Rumut"), or behind it if the kind of work stands before ("of STP works, Tokide")."""
    parts = tail.split(",")
    while len(parts) > 1 and len(village(parts[-1])) < 3:
        parts.pop()
    return parts[-1] if any(kind(x)[0] for x in parts[:-1]) else parts[0]


def title_parts(title: str | None) -> tuple[str, str, str, int] | None:
    """(village, side, kind, phase) of a work's title, None without a kind or a place."""
    if not title or not title.strip():
        return None
    t = re.sub(r"\s+", " ", title.strip())
    k, _ = kind(t)
    if not k:
        return None
    p = phase(t)
    rest = re.sub(r"\s+", " ", _PHASE.sub(" ", _TALUKA.sub("", t))).strip(" ,")
    place = None
    if _DEVANAGARI.search(rest) and not re.search(r"[A-Za-z]{3}", rest):
        words = rest.split()
        place = words[0] if words else None
    elif re.match(r"^[^:]{3,40}:\s", rest):
        place = rest.split(":", 1)[0]
    else:
        at = list(_BEFORE.finditer(rest))
        if at:
            place = _named(rest[at[-1].end() :])
        elif "," in rest:
            place = rest.rsplit(",", 1)[1]
    if not place:
        return None
    v = village(place)
    return (v, side(rest), k, p) if len(v) >= 3 else None
