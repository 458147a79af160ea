"""Ranked search over records of several kinds, with a small query language.

Terms are all required; "above 5 crore", "under 20 lakh" and "since 2026" narrow by amount and date (unknown values
never match a narrowing). A word of the title scores more than a word's beginning, and that more than a part of a word.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_UNITS = {"crore": 10_000_000, "cr": 10_000_000, "lakh": 100_000, "lac": 100_000, "l": 100_000, "k": 1_000, "thousand": 1_000, "": 1}
_AMOUNT = re.compile(r"\b(above|over|more than|under|below|less than)\s+(\d+(?:\.\d+)?)\s*(crore|cr|lakh|lac|thousand|k|l)?\b", re.IGNORECASE)
_SINCE = re.compile(r"\b(since|after|before)\s+((?:19|20)\d\d)(?:-(\d\d))?\b", re.IGNORECASE)
WHOLE, START, INSIDE, ELSEWHERE = 10, 6, 3, 1


@dataclass
class Query:
    terms: list[str] = field(default_factory=list)
    least: Decimal | None = None
    most: Decimal | None = None
    since: str | None = None
    before: str | None = None
    kinds: list[str] = field(default_factory=list)


def parse_query(text: str) -> Query:
    q = Query()
    for m in _AMOUNT.finditer(text):
        value = Decimal(m[2]) * _UNITS[(m[3] or "").lower()]
        if m[1].lower() in ("above", "over", "more than"):
            q.least = value
        else:
            q.most = value
    for m in _SINCE.finditer(text):
        day = f"{m[2]}-{m[3] or '01'}-01"
        if m[1].lower() == "before":
            q.before = day
        else:
            q.since = day
    rest = _SINCE.sub(" ", _AMOUNT.sub(" ", text))
    for w in re.findall(r"[\wऀ-ॿ:]+", rest.lower()):
        if w.startswith("type:"):
            q.kinds.append(w[5:])
        elif w not in q.terms:
            q.terms.append(w)
    return q


def search(corpus: DataFrame, query: str | Query, top: int = 80) -> DataFrame:
    """(kind, id, title, score, share_of_best): the ``top`` records by score, then title and id.

    ``corpus`` has kind, id, title, body, amount, day. An empty query gives nothing. The top-k is the feature: it is a
    TakeOrdered with a heap per task, never a sort of all hits.
    """
    q = parse_query(query) if isinstance(query, str) else query
    title, body = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("body", F.lit("")))
    scores = []
    for t in q.terms:
        word = re.escape(t)
        scores.append(
            F.when(title.rlike(rf"(?U)(^|\W){word}(\W|$)"), WHOLE).when(title.rlike(rf"(?U)(^|\W){word}"), START).when(title.contains(t), INSIDE)
            .when(body.contains(t), ELSEWHERE).otherwise(0)
        )
    if not scores and q.least is None and q.most is None and q.since is None and q.before is None and not q.kinds:
        scores = [F.lit(0)]
    hits = corpus
    if q.kinds:
        hits = hits.filter(F.col("kind").isin(*q.kinds))
    if q.least is not None:
        hits = hits.filter(F.col("amount") >= F.lit(q.least))
    if q.most is not None:
        hits = hits.filter(F.col("amount") <= F.lit(q.most))
    if q.since:
        hits = hits.filter(F.col("day") >= F.lit(q.since).cast("date"))
    if q.before:
        hits = hits.filter(F.col("day") < F.lit(q.before).cast("date"))
    scored = hits.select("kind", "id", "title", *[s.alias(f"s{i}") for i, s in enumerate(scores)])
    for i in range(len(scores)):
        scored = scored.filter(F.col(f"s{i}") > 0)
    total = reduce(lambda a, b: a + b, [F.col(f"s{i}") for i in range(len(scores))], F.lit(0)).cast("bigint")
    best = scored.select("kind", "id", "title", total.alias("score")).orderBy(F.desc("score"), "title", "kind", "id").limit(top)
    top_score = best.agg(F.max("score").alias("top_score"))
    return best.crossJoin(F.broadcast(top_score)).select("kind", "id", "title", "score", F.round(100.0 * F.col("score") / F.greatest("top_score", F.lit(1)), 2).alias("share_of_best"))


def facets(corpus: DataFrame) -> DataFrame:
    """Records per kind."""
    return corpus.groupBy("kind").agg(F.count("*").alias("n"))
