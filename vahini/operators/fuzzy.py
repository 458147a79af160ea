"""Blocked fuzzy joins: duplicates across sources and later counterparts within a window.

A block is an equality (normal organisation) together with steps of time and value, each row sent to its own step and
the neighbouring one, so only rows that can be within the tolerance meet. A third of all rows may belong to one
organisation; the time and value steps split it, and AQE splits what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vahini.functions.money import values_close
from vahini.functions.text import set_ratio, sets_ratio, word_set


def _near_step(c: Column, width: float) -> Column:
    return F.floor(c / width).cast("bigint")


def duplicate_pairs(rows: DataFrame, ratio: float = 90.0, days: int = 1, share: float = 0.02) -> DataFrame:
    """(id_a, id_b), id_a < id_b, for rows(id, org, title, day, value): same organisation, titles alike, days and values close.

    Days: both unknown, or at most ``days`` apart. Values: both unknown, or within ``share`` of the greater (zeros never).
    Rows with neither meet on words: of two titles alike the smaller one's words are in the other but for a tenth, so one
    of its first words (the longest, one more than a tenth of them) is among the other's. NULL organisations or titles
    have no duplicates.
    """
    width = max(days, 1) + 1
    day_step = _near_step(F.datediff("day", F.lit("2000-01-01")), width)
    # Two values within the share are at most one step of -log(1 - share) apart.
    value_step = F.when(F.col("value") > 0, F.floor(F.log(F.col("value").cast("double")) / -F.log(F.lit(1 - share))).cast("bigint"))
    base = rows.filter("org IS NOT NULL AND title IS NOT NULL").filter("value IS NULL OR value > 0")
    base = base.select("id", "org", "title", "day", "value", day_step.alias("ds"), value_step.alias("vs"))
    here = base.select(F.struct("id", "title", "day", "value").alias("a"), "org", F.coalesce("ds", F.lit(-(2**40))).alias("d"), F.coalesce("vs", F.lit(-(2**40))).alias("v"))
    steps = lambda c: F.when(F.col(c).isNull(), F.array(F.lit(-(2**40)))).otherwise(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1))
    there = base.select(F.struct("id", "title", "day", "value").alias("b"), "org", F.explode(steps("ds")).alias("d"), "vs").select("b", "org", "d", F.explode(steps("vs")).alias("v"))
    dated = F.col("ds").isNotNull() | F.col("vs").isNotNull()
    here, there = here.filter(f"d <> {-(2**40)} OR v <> {-(2**40)}"), there.filter(f"d <> {-(2**40)} OR v <> {-(2**40)}")
    pairs = here.join(there, ["org", "d", "v"]).filter("a.id < b.id").select("a", "b").unionByName(_by_words(base.filter(~dated), 1 - ratio / 100))
    close_day = F.col("a.day").isNull() | (F.abs(F.datediff("a.day", "b.day")) <= days)
    pairs = pairs.filter(close_day & values_close(F.col("a.value"), F.col("b.value"), share))
    return pairs.filter(set_ratio(F.col("a.title"), F.col("b.title")) >= ratio).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))


def _by_words(rows: DataFrame, off: float) -> DataFrame:
    """(a, b), a.id < b.id: rows of one organisation of which one's first words meet the other's words."""
    words = F.filter(word_set(F.col("title")), lambda w: w != "")
    longest = F.transform(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w")))), lambda x: x["w"])
    one = rows.select("org", F.struct("id", "title", "day", "value").alias("r"), longest.alias("ws"))
    first = one.select("org", F.col("r").alias("x"), F.explode(F.slice("ws", 1, F.floor(F.size("ws") * off + 1e-9).cast("int") + 1)).alias("w"))
    every = one.select("org", F.col("r").alias("y"), F.explode("ws").alias("w"))
    met = first.join(every, ["org", "w"]).filter("x.id <> y.id")
    swap = F.col("x.id") < F.col("y.id")
    return met.select(F.when(swap, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(swap, F.col("y")).otherwise(F.col("x")).alias("b")).distinct()


def counterparts(originals: DataFrame, later: DataFrame, window_days: int = 180, ratio: float = 90.0, share: float = 0.02) -> DataFrame:
    """(id, later_id): for each original the first later row of the same work, each later row used by one original.

    Both have (id, org, title, day, value). Within ``window_days`` from the original's day; the earliest counterpart is
    taken (then the smallest id), and of two originals that want the same row the earlier has it.
    """
    step = lambda c: F.floor(F.datediff(c, F.lit("2000-01-01")) / window_days).cast("bigint")
    # Two values within the share are at most one step apart (of a step a little wider, as logarithms are rounded); NULL meets NULL.
    unknown = -(2**40)
    vs = F.when(F.col("value").isNull(), F.lit(unknown)).otherwise(F.floor(F.log(F.col("value").cast("double")) / (-F.log(F.lit(1 - share)) * 1.000001))).cast("bigint")
    near = F.when(F.col("vs") == unknown, F.array("vs")).otherwise(F.array(F.col("vs") - 1, F.col("vs"), F.col("vs") + 1))

    def side(rows: DataFrame, n: str) -> DataFrame:
        kept = rows.filter("org IS NOT NULL AND title IS NOT NULL AND day IS NOT NULL").filter("value IS NULL OR value > 0").withColumns({"vs": vs, "words": word_set(F.col("title"))})
        return kept.select(F.struct("id", "words", "day", "value").alias(n), "org", "vs", step(F.col("day")).alias("s"))

    a = side(originals, "a").withColumn("s", F.explode(F.array(F.col("s"), F.col("s") + 1))).withColumn("vs", F.explode(near))
    gap = F.datediff("b.day", "a.day")
    pairs = a.join(side(later, "b"), ["org", "s", "vs"]).filter((gap >= 0) & (gap <= window_days) & (F.col("a.id") != F.col("b.id")))
    pairs = pairs.filter(values_close(F.col("a.value"), F.col("b.value"), share)).filter(sets_ratio(F.col("a.words"), F.col("b.words")) >= ratio)
    first = pairs.groupBy(F.col("a.id").alias("id"), F.col("a.day").alias("day")).agg(F.min(F.struct("b.day", "b.id")).alias("first"))
    taken = first.groupBy(F.col("first.id").alias("later_id")).agg(F.min(F.struct("day", "id")).alias("who"))
    return taken.select(F.col("who.id").alias("id"), "later_id")
