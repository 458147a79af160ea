"""Text expressions shared by the operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Devanagari digits in order of value.
DEVANAGARI_DIGITS = "०१२३४५६७८९"

# What people type where a value is not known (compared after trimming, in lower case).
FILLERS = (
    "", "-", "--", "---", "?", "??", ".", "na", "n.a.", "n.a", "n/a", "nil", "none", "null", "tbd", "unknown", "not known",
    "not available", "not specified", "not applicable", "not given", "not mentioned", "to be announced", "to be decided",
    "other", "others", "xx", "xxx", "निरंक", "माहिती नाही", "लागू नाही", "उपलब्ध नाही", "अज्ञात",
)


def ascii_digits(c: Column) -> Column:
    return F.translate(c, DEVANAGARI_DIGITS, "0123456789")


def squeeze(c: Column) -> Column:
    """Trim and collapse runs of white space, the no-break space included."""
    return F.trim(F.regexp_replace(c, r"[\s ​﻿]+", " "))


def is_filler(c: Column) -> Column:
    """True for NULL, blank and every filler; never NULL."""
    return F.coalesce(F.lower(squeeze(c)).isin(*FILLERS), F.lit(True))


def known(c: Column) -> Column:
    """The value as typed, or NULL where it is a filler."""
    return F.when(~is_filler(c), c)


# Legal forms and forms of address that are no part of a name.
LEGAL_FORMS = r"(?i)\b(private|pvt|limited|ltd|llp|co|company|inc|corp|and|m/?s|messrs|shri|smt|mr|mrs|dr)\b\.?"
# What comes before a cell that a spreadsheet would run as a formula.
FORMULA_START = r"^[=+\-@\t\r]"


def clean(c: Column) -> Column:
    """Dashes, quotes and odd spaces in their plain form; single spaces."""
    return squeeze(F.translate(c, "–—−‐‑‘’“”", "-----''\"\""))


def normal_org(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}]+", " "))


def normal_name(c: Column) -> Column:
    """Lower case without legal forms, forms of address and punctuation; the whole name where nothing would be left."""
    short = squeeze(F.regexp_replace(F.regexp_replace(F.lower(c), LEGAL_FORMS, " "), r"[^\p{L}\p{M}\p{N}]+", " "))
    return F.coalesce(F.nullif(short, F.lit("")), normal_org(c))


def word_set(c: Column) -> Column:
    """Distinct lower-case words, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(normal_org(c), " "), lambda w: w != "")))


def set_ratio(a: Column, b: Column) -> Column:
    """0 to 100: 100 where one word set holds the other, else the Dice share of the words."""
    return sets_ratio(word_set(a), word_set(b))


def sets_ratio(x: Column, y: Column) -> Column:
    """``set_ratio`` of two word sets."""
    both, least = F.size(F.array_intersect(x, y)), F.least(F.size(x), F.size(y))
    return F.when(least == 0, 0.0).when(both == least, 100.0).otherwise(F.round(200.0 * both / (F.size(x) + F.size(y)), 4))


def first_rule(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern that matches, in order."""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(c.rlike(pattern), F.lit(label)).otherwise(out)
    return F.when(c.isNull(), F.lit(default)).otherwise(out)


def uuid5(namespace: str, *parts: Column) -> Column:
    """Name-based UUID (version 5) of the parts joined by '|', equal to Python's; NULL parts count as ''."""
    name = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    part = lambda i, n: F.substring(h, i, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def safe_cell(c: Column) -> Column:
    """A text that no spreadsheet takes for a formula."""
    return F.when(c.rlike(FORMULA_START), F.concat(F.lit("'"), c)).otherwise(c)


def org_chain(c: Column) -> Column:
    """Segments of an organisation chain separated by '||', empty ones left out."""
    return F.filter(F.transform(F.split(c, r"\|\|"), lambda x: F.trim(x)), lambda x: x != "")


# Forms of address before a contractor's name, and legal forms that are no part of its key.
ADDRESS_FORMS = r"(?i)^(m\s*/?\s*s\.?|messrs\.?|shri\.?|sri\.?|smt\.?|mr\.?|mrs\.?)\s+"
KEY_FORMS = r"\b(pvt|private|ltd|limited|co|company|corporation|corp)\b"


def display_name(c: Column) -> Column:
    """A name as typed, without outer punctuation and odd spaces."""
    return F.regexp_replace(clean(c), r"^[ .,-]+|[ .,-]+$", "")


def contractor_key(c: Column) -> Column:
    """One key for a name's spellings with and without forms of address and legal forms; the bare name where nothing would be left."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(display_name(c), ADDRESS_FORMS, ""), r"^[ .,-]+|[ .,-]+$", ""))
    short = squeeze(F.regexp_replace(F.regexp_replace(bare, r"[.,&'\"()/\\-]", " "), KEY_FORMS, " "))
    return F.coalesce(F.nullif(short, F.lit("")), bare)


def partial(a: Column, b: Column) -> Column:
    """100 where one text (lower case, single spaces) is in the other, else 0; 0 for NULL and blank ones."""
    x, y = squeeze(F.lower(a)), squeeze(F.lower(b))
    return F.when((F.length(x) > 0) & (F.length(y) > 0) & (x.contains(y) | y.contains(x)), 100).otherwise(0)


def distinctive(c: Column, generic: tuple[str, ...], least: int = 4) -> Column:
    """Distinct Latin words of at least so many letters, in lower case, without the generic ones."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(rf"([a-z]{{{least},}})"), F.lit(1)))
    return F.array_except(words, F.array(*map(F.lit, generic)))


def first_listed(c: Column, names: list[str]) -> Column:
    """The first of the names, in their order, that is in the text whatever the case; NULL if none is."""
    low = F.lower(c)
    return F.try_element_at(F.filter(F.array(*map(F.lit, names)), lambda n: low.contains(F.lower(n))), F.lit(1))


def title_block(c: Column, id_pattern: str) -> Column:
    """struct(title, ref, id) of "[title] [reference][id]": the id is last, the reference the bracketed group before it (it
    may hold bracketed groups itself). Without an id everything is the title."""
    whole = rf"^(.*?)\s*(?:\[((?:[^\[\]]|\[[^\[\]]*\])*)\])?\s*\[({id_pattern})\]\s*$"
    has = c.rlike(whole)
    strip = lambda x: F.regexp_replace(x, r"^[\[\]\s]+|[\[\]\s]+$", "")
    part = lambda i: F.when(has, F.trim(F.regexp_extract(c, whole, i))).otherwise("")
    return F.struct(F.when(has, strip(F.regexp_extract(c, whole, 1))).otherwise(strip(c)).alias("title"), part(2).alias("ref"), part(3).alias("id"))


def first_int(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit("")).try_cast("int")


def caption(pairs: Column, keys: list[str]) -> Column:
    """The first non-empty value of a caption map under one of the keys, in their order: equal captions first, then those that hold a key."""
    known = F.filter(F.map_entries(pairs), lambda e: F.trim(e["value"]) != "")
    low = lambda e: F.lower(F.trim(e["key"]))
    first = lambda test: F.try_element_at(F.filter(known, test), F.lit(1))["value"]

    def equals(k: str):
        return lambda e: low(e) == k.lower()

    def holds_it(k: str):
        return lambda e: low(e).contains(k.lower())

    equal, holds = [first(equals(k)) for k in keys], [first(holds_it(k)) for k in keys]
    return F.trim(F.coalesce(*equal, *holds))


def script(c: Column) -> Column:
    """'mr' where a text has Devanagari letters, else 'en'."""
    return F.when(F.coalesce(c, F.lit("")).rlike("[\\u0900-\\u097F]"), "mr").otherwise("en")


# Funding schemes with what names them, in the order in which they are tried.
SCHEMES = (
    (r"(?i)\bjjm\b|jal jeevan", "Jal Jeevan Mission"), (r"(?i)\bpmgsy\b|pradhan mantri gram sadak", "PMGSY"), (r"(?i)\bamrut\b", "AMRUT"), (r"(?i)nagarothan|nagrotthan", "Nagarothan"),
    (r"(?i)amdar|aamdar|\bmla\b fund|mla local|आमदार", "Amdar Nidhi / MLA fund"), (r"(?i)khasdar|\bmp\b fund|mplad|खासदार", "Khasdar / MP fund"),
    (r"(?i)\bdpdc\b|d\.p\.d\.c|district planning|जिल्हा नियोजन|niyojan", "DPDC / District Planning"), (r"(?i)dalit\s*vasti|dalitvasti|dalit wasti", "Dalit Vasti"),
    (r"(?i)15th finance|vitta ayog|vitt ayog", "15th Finance Commission"), (r"(?i)nrega|mgnrega|rojgar hami", "MGNREGA"),
)
# Publishers of a level.
LEVELS = ((r"(?i)nhai|morth|cpwd|\baai\b|jnpa|railway|central|world bank|\badb\b", "central"), (r"(?i)municipal|corporation|nagar palika|zilla parishad|gram panchayat|\bzp\b", "local"))


def funding_scheme(c: Column) -> Column:
    return first_rule(c, list(SCHEMES), "")


def funding_level(c: Column) -> Column:
    return first_rule(c, list(LEVELS), "state")


def funding_source(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(low.contains("world bank"), "world_bank").when(low.rlike(r"\badb\b|asian development"), "adb").when(funding_scheme(c) != "", "css").otherwise("unknown")
