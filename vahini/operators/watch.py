"""Watches, facets and budgets over lists of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tag_watches(rows: DataFrame, hay: Column, watches: list[tuple[str, str]]) -> DataFrame:
    """Rows that any watch (name, pattern) matches, once, with the names of all that do, in the order given.

    The watches are a list in the program; they become one expression, so there is no join. NULL text matches none.
    """
    tags = F.array_compact(F.array(*[F.when(F.coalesce(hay.rlike(p), F.lit(False)), F.lit(n)) for n, p in watches]))
    return rows.withColumn("watches", tags).filter(F.size("watches") > 0)


def any_keyword(hay: Column, words: list[str]) -> Column:
    """Any of the words in the text, whatever the case; no words match nothing."""
    low = F.lower(F.coalesce(hay, F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w.lower())
    return out


def facet_filter(rows: DataFrame, equal: dict[str, str], text: str = "", fields: tuple[str, ...] = ()) -> DataFrame:
    """Rows that have all the values (in lower case) and the text in one of the fields; empty choices don't narrow."""
    out = rows
    for c, v in equal.items():
        if v:
            out = out.filter(F.lower(F.trim(c)) == v.lower())
    return out.filter(F.lower(F.concat_ws(" ", *fields)).contains(text.lower())) if text else out


def deadline(ends: Column, now: Column) -> Column:
    """closed, urgent (under a day), soon (under three), open; NULL without a deadline."""
    days = (F.unix_timestamp(ends.cast("timestamp")) - F.unix_timestamp(now.cast("timestamp"))) / 86400.0
    return F.when(days < 0, "closed").when(days < 1, "urgent").when(days < 3, "soon").when(days.isNotNull(), "open")


def url_on(c: Column, hosts: tuple[str, ...]) -> Column:
    """An https address on one of the hosts (or below one); broken addresses are on none."""
    host = F.lower(F.try_parse_url(c, F.lit("HOST")))
    below = F.lit(False)
    for h in hosts:
        below = below | (host == h) | host.endswith("." + h)
    return F.coalesce((F.try_parse_url(c, F.lit("PROTOCOL")) == "https") & below, F.lit(False))


def budgeted(rows: DataFrame, done: DataFrame, key: str, priority: Column, budget: int) -> DataFrame:
    """The rows still to do, those of the highest priority first, up to a budget (the feature of a rate-limited poll)."""
    return rows.join(done.select(key).distinct(), key, "left_anti").orderBy(priority.desc(), key).limit(budget)


def merge_live(old: DataFrame, fresh: DataFrame, key: str, tags: str) -> DataFrame:
    """Fresh rows before old ones, their tags (arrays) united, old rows that are gone kept."""
    o, f = old.select(F.col(key), F.struct(*old.columns).alias("o")), fresh.select(F.col(key), F.struct(*fresh.columns).alias("f"))
    both = o.join(f, key, "full_outer")
    empty = F.array().cast(old.schema[tags].dataType)
    pick = lambda c: F.when(F.col("f").isNotNull(), F.col(f"f.{c}")).otherwise(F.col(f"o.{c}"))
    union = F.array_sort(F.array_union(F.coalesce(F.col(f"o.{tags}"), empty), F.coalesce(F.col(f"f.{tags}"), empty)))
    return both.select(*[F.col(key) if c == key else union.alias(c) if c == tags else pick(c).alias(c) for c in old.columns])


def audit(rows: DataFrame, before: Column, after: Column) -> DataFrame:
    """How many values a re-reading changes: scanned, unknown, unchanged, corrected."""
    same = F.coalesce(before == after, before.isNull() & after.isNull())
    return rows.agg(
        F.count("*").alias("n_scanned"), F.count_if(after.isNull()).alias("n_unknown"), F.count_if(after.isNotNull() & same).alias("n_unchanged"), F.count_if(after.isNotNull() & ~same).alias("n_corrected")
    )


def sorted_list(rows: DataFrame, column: str, descending: bool, key: str, most: int) -> DataFrame:
    """The first rows in the order of a column, texts whatever their case, unknown values last, ties by key (the feature of a list of bounded length)."""
    c = F.lower(column) if rows.schema[column].dataType.typeName() == "string" else F.col(column)
    return rows.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), key).limit(limit(most, most))


def limit(typed: str | int | None, default: int) -> int:
    """A number of rows as typed; what is no number or negative is the default."""
    try:
        n = int(str(typed))
    except ValueError:
        return default
    return n if n >= 0 else default


def reject_reason(c: Column, hosts: tuple[str, ...], ending: str) -> Column:
    """Why an address is not taken: 'no address', 'not https', 'host' or 'no <ending>', else 'accepted'."""
    return (
        F.when(c.isNull(), "no address").when(~c.startswith("https://"), "not https").when(~url_on(c, hosts), "host")
        .when(~c.rlike(rf"(?i)\.{ending}$"), f"no {ending}").otherwise("accepted")
    )


def relevance(reasons: list[tuple[str, Column]]) -> Column:
    """The first reason that holds, NULL if none does (an unknown one does not)."""
    return F.coalesce(*[F.when(hit, F.lit(name)) for name, hit in reasons])
