"""Facts out of the text of an approval document, each with what is missing or doubtful; no Python runs over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vahini.functions.money import text_amounts
from vahini.functions.text import first_rule, script

#: A text with fewer characters has no usable layer.
LEAST_CHARS = 40
#: Share by which a sum of parts may differ from the stated total.
TOLERANCE = 0.02
# What an approval document's kind, scheme and theme is told from, in the order in which they are tried.
KINDS = (
    (r"(?i)निधी वितरण|निधी वितरीत|fund release|release of funds", "fund_release"), (r"(?i)तांत्रिक मान्यता|technical sanction", "technical_sanction"),
    (r"(?i)प्रशासकीय मान्यता देण्याबाबत|administrative approval", "administrative_approval"), (r"(?i)निधी मंजूर|निधी उपलब्ध|अनुदान|मंजूर करण्याबाबत|sanction of funds", "funding_sanction"),
    (r"(?i)सुधारित प्रशासकीय|सुधारीत प्रशासकीय|revised administrative|revised sanction", "revised_sanction"),
)
THEMES = (
    (r"(?i)पाणीपुरवठा|जलवाहिनी|water supply|intake well|jack well|pump house|rising main|wtp|esr|mbr", "water_supply"), (r"(?i)मलनिस्सारण|सांडपाणी|sewerage|sewage|drainage", "sewerage"),
    (r"(?i)रस्ते|रस्ता|road|bridge|पूल", "roads"),
)
CODE = r"([0-9]{13,20})"
ORDER_NUMBER = r"(?i)(?:शासन\s*निर्णय\s*क्रमांक|G\.?R\.?\s*No)\s*[:.\-]*\s*([^\n]{4,80})"
OFFICE = r"((?:Executive|Superintending|Chief)\s+Engineer,?\s+[A-Z][A-Za-z ]{0,40}?(?:Sub-?division|Division|Region|Circle))"
WORKS = r"\(([A-Za-z][^()]{16,160})\)"


def kind(title: Column, body: Column) -> Column:
    """By the document's own title, else by its text, else 'other'."""
    own = first_rule(title, list(KINDS), "")
    return F.coalesce(F.nullif(own, F.lit("")), first_rule(body, list(KINDS), "other"))


def document_code(url: Column, body: Column) -> Column:
    """The long number in the address, else in the text."""
    found = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), CODE, 1), F.lit(""))
    return F.coalesce(found(url), found(body))


def passage(body: Column, at: Column, before: int = 60, width: int = 180) -> Column:
    """The text around a position counted from 1, single-spaced; NULL for none."""
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.trim(F.regexp_replace(F.substring(body, start, at + width - start), r"\s+", " ")))


def role(body: Column, name: str, roles: list[tuple[str, str, float]], mentioned: float = 0.3) -> Column:
    """struct(role, confidence, at): of the roles (pattern, name, confidence) the first whose words stand beside the office's name.

    The name alone is "mentioned" at low confidence, without it the role is "none"; ``at`` is where the name stands.
    """
    text = F.coalesce(body, F.lit(""))
    here = text.rlike(name)
    what, sure = F.lit("mentioned"), F.lit(mentioned)
    for pattern, label, confidence in reversed(roles):
        what = F.when(text.rlike(pattern), F.lit(label)).otherwise(what)
        sure = F.when(text.rlike(pattern), F.lit(confidence)).otherwise(sure)
    at = F.regexp_instr(text, F.lit(name))
    return F.struct(F.when(here, what).otherwise("none").alias("role"), F.when(here, sure).otherwise(0.0).alias("confidence"), F.when(here, at).otherwise(0).alias("at"))


def extract(papers: DataFrame, title: Column, body: Column, url: Column, name: str, roles: list[tuple[str, str, float]]) -> DataFrame:
    """The papers with a struct ``facts``: code, kind, language, theme, total, parts, works, office, order number, role, what is missing and what is doubtful.

    The total is the greatest amount of the text; the other amounts are its parts. NULL and short texts give facts in
    which all is missing. What several facts need is computed once, as a column on the way.
    """
    text = F.coalesce(body, F.lit(""))
    way = {"f_amounts": text_amounts(text), "f_role": role(body, name, roles), "f_code": document_code(url, body)}
    total, said, code = F.array_max("f_amounts"), F.col("f_role"), F.col("f_code")
    d = papers.select("*", *[c.alias(n) for n, c in way.items()]).select("*", total.alias("f_total"))
    total = F.col("f_total")
    d = d.select("*", F.filter("f_amounts", lambda a: a < total).alias("f_parts"))
    summed = F.aggregate("f_parts", F.lit(0).cast("decimal(38,6)"), lambda s, a: (s + a).cast("decimal(38,6)"))
    d = d.select("*", summed.alias("f_sum"))
    none = lambda c: F.nullif(c, F.lit(""))
    readable = F.length(F.trim(text)) >= LEAST_CHARS
    differs = F.coalesce((F.size("f_parts") > 0) & (F.abs(F.col("f_sum") - total) > total * F.lit(TOLERANCE).cast("decimal(3,2)")), F.lit(False))
    facts = {
        "code": code, "kind": kind(title, body), "language": script(body), "theme": first_rule(body, list(THEMES), "other"), "total_inr": total, "n_parts": F.size("f_parts"), "parts_inr": F.col("f_sum"), "differs": differs,
        "role": said["role"], "confidence": said["confidence"], "evidence": passage(body, said["at"]), "works": F.array_distinct(F.regexp_extract_all(text, F.lit(WORKS), F.lit(1))),
        "office": none(F.regexp_extract(text, OFFICE, 1)), "order_number": none(F.trim(F.regexp_extract(text, ORDER_NUMBER, 1))), "readable": readable,
        "missing": F.array_compact(F.array(F.when(total.isNull(), "total"), F.when(said["role"] == "none", "role"), F.when(code.isNull(), "code"))),
        "doubtful": F.array_compact(F.array(F.when(~readable, "no text layer"), F.when(said["role"] == "mentioned", "role not stated"), F.when(differs, "parts differ from total"))),
    }
    return d.select(*papers.columns, F.struct(*[c.alias(n) for n, c in facts.items()]).alias("facts"))
