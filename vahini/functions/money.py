"""Exact money: parsing of typed amounts, scaling words, display forms and tolerant comparison, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vahini.functions.text import ascii_digits

MONEY = "decimal(28,6)"


def currency(c: Column) -> Column:
    """'INR' where a rupee sign or word occurs, else ''."""
    return F.when(c.rlike(r"(?i)(\binr\b|\brs\b\.?|rupee|₹)"), F.lit("INR")).otherwise(F.lit(""))


def parse_amount(c: Column) -> Column:
    """The exact amount of a text, NULL if there is none.

    Currency words, a trailing "/-" and white space don't count. A leading minus or brackets make it negative. Where both
    separators occur the last one is the decimal point; a single comma before one or two last digits is one as well.
    """
    s = F.regexp_replace(ascii_digits(c), r"(?i)(inr|rs\.?|rupees?|₹|/-)", " ")
    negative = s.rlike(r"^\s*(-|\(.*\)\s*$)")
    s = F.regexp_replace(s, r"[^0-9.,]", "")
    s = F.regexp_replace(s, r"^[.,]+|[.,]+$", "")
    dot_at, comma_at = F.length(s) - F.instr(F.reverse(s), "."), F.length(s) - F.instr(F.reverse(s), ",")
    both = s.contains(".") & s.contains(",")
    european = (both & (comma_at > dot_at)) | (~s.contains(".") & s.rlike(r"^\d+,\d{1,2}$"))
    plain = F.when(european, F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(s, F.lit(","), F.lit("")))
    value = F.when(plain.rlike(r"^\d+(\.\d+)?$"), plain).try_cast(MONEY)
    return F.when(negative, -value).otherwise(value)


def scaled_amount(c: Column, default_unit: str = "") -> Column:
    """``parse_amount`` with crore, lakh and thousand words; a number of at least one lakh is in full rupees already."""
    s = F.lower(ascii_digits(c))
    unit = (
        F.when(s.rlike(r"(crore|\bcr\b|कोटी)"), F.lit(10_000_000))
        .when(s.rlike(r"(lakh|lac\b|लक्ष|लाख)"), F.lit(100_000))
        .when(s.rlike(r"(thousand|हजार)"), F.lit(1_000))
        .otherwise(F.lit({"crore": 10_000_000, "lakh": 100_000, "thousand": 1_000}.get(default_unit, 1)))
    )
    number = parse_amount(F.regexp_extract(s, r"(-?\(?[0-9][0-9.,]*\)?)", 1))
    return F.when(number >= 100_000, number).otherwise((number * unit).cast(MONEY))


def group_digits(whole: Column) -> Column:
    """Indian grouping of a string of digits: 12,34,567."""
    head, tail = F.regexp_extract(whole, r"^(\d*?)(\d{1,3})$", 1), F.regexp_extract(whole, r"^(\d*?)(\d{1,3})$", 2)
    return F.when(F.length(head) == 0, tail).otherwise(F.concat_ws(",", F.regexp_replace(head, r"(?<=\d)(?=(\d\d)+$)", ","), tail))


def format_inr(v: Column) -> Column:
    """Crores from 1e7, lakhs from 1e5, else grouped rupees; half-even to two places, '-' for NULL."""
    size = F.abs(v)
    short = lambda x: F.regexp_replace(F.regexp_replace(F.bround(x, 2).cast("decimal(28,2)").cast("string"), r"0+$", ""), r"\.$", "")
    rupees = F.bround(size, 0).cast("decimal(28,0)").cast("string")
    shown = (
        F.when(size >= 10_000_000, F.concat(short(size / 10_000_000), F.lit(" Cr")))
        .when(size >= 100_000, F.concat(short(size / 100_000), F.lit(" L")))
        .otherwise(group_digits(rupees))
    )
    return F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.when(v < 0, F.lit("-₹")).otherwise(F.lit("₹")), shown))


def values_close(a: Column, b: Column, share: float = 0.02) -> Column:
    """Within a share of the greater; two unknowns are close, one isn't, nor are two zeros."""
    top = F.greatest(a, b)
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).when(top <= 0, False).otherwise(F.abs(a - b) <= top * share)


def value_bucket(v: Column, share: float = 0.02) -> Column:
    """Logarithmic step: values in one step differ by at most the share. NULL for unknown or non-positive."""
    return F.when(v > 0, F.floor(F.log(v.cast("double")) / F.log(F.lit(1 + share))).cast("bigint"))


def known_sum(v: Column) -> Column:
    """Exact sum of what is known, 0 if nothing is."""
    return F.coalesce(F.sum(v), F.lit(0)).cast("decimal(38,2)")


def plain_text(v: Column) -> Column:
    """The exact amount as text without an exponent or zeros at the end; NULL stays NULL."""
    s = v.cast("string")
    return F.when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)


def text_amounts(c: Column) -> Column:
    """All amounts of a text, in its order: after a rupee sign or word, or before a crore word (in full rupees)."""
    s = ascii_digits(c)
    number = r"([0-9][0-9,]*(?:\.[0-9]+)?)"
    exact = lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast(MONEY)
    rupees = F.transform(F.regexp_extract_all(s, F.lit(rf"(?i)(?:रु|\brs|\binr|₹)\.?\s*{number}"), F.lit(1)), exact)
    crores = F.transform(F.regexp_extract_all(s, F.lit(rf"(?i){number}\s*(?:कोटी|कोटि|crore)"), F.lit(1)), lambda x: (exact(x) * F.lit(10_000_000)).cast(MONEY))
    return F.array_compact(F.concat(rupees, crores))
