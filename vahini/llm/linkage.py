"""Problem 5: approval projects and tenders of the same work, without a common identifier.

Place names become bit vectors: every pair of letters of the bare name sets one of 576 bits, in ``BLOCKS`` = 9 blocks of
64. One edit changes at most four bits, so names at most two edits apart are at most ``RADIUS`` = 8 bits apart. Then there
is a block that is equal, that with the next one holds at most one difference, with the next two at most two, and so on
round the circle (the sums of 9 numbers that add up to at most 8). Both sides send, for every block to begin with, what
can be left of it and the following ones when so many bits are taken out, as many blocks as it takes to have a bit at all:
all close pairs meet, and no key stands for "no bits". Distinct names meet, not records, and only within one kind of work,
phase and side (Budruk, Khurd); districts are read for the records of names that met. Joins of two growing sides merge,
as sides that the optimiser's estimate would send out are first put together on the driver.

A pair's score is the weighted Dice of its fields. Scores become confidences without labels: the cost is kept out of
the score, and in each score bin the share of pairs whose costs agree, beyond the share by chance, tells how many are
right; the bins are made monotonous.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vahini.llm.places import map_places
from vahini.llm.works import kind, phase, side, title_parts, village
from vahini.session import cut, spread

BLOCKS = 9
RADIUS = BLOCKS - 1
#: A tender's estimate can belong to a project from this share of its approved or revised cost to that.
COST_FROM, COST_TO = 0.75, 1.15
WEIGHTS = {"village": 0.7, "district": 0.2, "taluka": 0.1}
BINS = 20


def vector(name: str) -> list[int]:
    """The blocks of a name's bits."""
    out = [0] * BLOCKS
    padded = f"^{name}$"
    for a, b in zip(padded, padded[1:]):
        h = zlib.crc32((a + b).encode()) % (64 * BLOCKS)
        out[h // 64] |= 1 << (h % 64)
    return out


def _without(x: int, most: int) -> list[tuple[int, int]]:
    """(what is left, how many are gone) with up to ``most`` of the set bits taken out."""
    set_bits = [1 << i for i in range(x.bit_length()) if x >> i & 1]
    return [(x ^ sum(c), n) for n in range(min(most, len(set_bits)) + 1) for c in combinations(set_bits, n)]


@lru_cache(100_000)
def block_keys(name: str) -> frozenset[int]:
    """Keys of which two names share one if their vectors are at most RADIUS bits apart."""
    blocks, out = vector(name), set()
    for begin in range(BLOCKS):
        todo = [(1, blocks[begin], 0)]
        while todo:
            n, left, gone = todo.pop()
            if left or n == BLOCKS:
                out.add(hash((begin, n, left)))
            else:
                # n + 1 blocks may differ in n bits.
                todo += [(n + 1, rest, gone + k) for rest, k in _without(blocks[(begin + n) % BLOCKS], n - gone)]
    return frozenset(out)


def located(rows: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """(key, d, t): the entries of the district and of the taluka that location_raw, district and taluka name, 0 where unknown."""
    own = places.filter("taluka IS NULL").select("district", F.col("place_id").alias("d"))
    entry = places.join(own, "district").select("place_id", "d", F.when(F.col("taluka").isNotNull(), F.col("place_id")).otherwise(0).alias("t"))
    named = map_places(rows, places, key).join(entry, "place_id", "left")
    return named.select(key, F.coalesce("d", F.lit(0)).alias("d"), F.coalesce("t", F.lit(0)).alias("t"))


_RECORD = "id string, v string, side string, kind string, phase int, low decimal(18,2), high decimal(18,2)"
_FIELDS = [c.split()[0] for c in _RECORD.split(", ")]


def _named(parts: DataFrame) -> DataFrame:
    return parts.withColumn("nid", F.xxhash64("v", "side", "kind", "phase"))


def project_parts(projects: DataFrame) -> DataFrame:
    """A row per project and spelling of its place (original title, English title, municipality)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for pid, original, english, town, approved, revised, works in zip(*(b[c] for c in b.columns)):
                titles = [x for x in (title_parts(original), title_parts(english)) if x]
                works = list(works) if works is not None else []
                k = titles[0][2] if titles else next((kind(w)[0] for w in works if w and kind(w)[0]), "")
                if not k:
                    continue
                p = titles[0][3] if titles else max((phase(w) for w in works if w), default=0)
                names = {(x[0], x[1]) for x in titles}
                if town and len(village(town)) >= 3:
                    names.add((village(town), side(town)))
                costs = [c for c in (approved, revised) if c is not None and c > 0]
                for v, s in sorted(names):
                    out.append((pid, v, s, k, p, min(costs, default=None), max(costs, default=None)))
            yield pd.DataFrame(out, columns=_FIELDS)

    columns = ["id", "title_original", "title_en", "municipality", "approved_cost_inr", "revised_cost_inr", "works_en"]
    return _named(spread(projects.select(*columns)).mapInPandas(read, _RECORD))


def tender_parts(tenders: DataFrame) -> DataFrame:
    """A row per tenders row with a place and a kind of work in its title."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row_id, title, cost in zip(*(b[c] for c in b.columns)):
                parts = title_parts(title)
                if parts:
                    cost = cost if cost is not None and cost > 0 else None
                    out.append((str(row_id), *parts, cost, cost))
            yield pd.DataFrame(out, columns=_FIELDS)

    return _named(spread(tenders.select("row_id", "title", "estimated_value_inr")).mapInPandas(read, _RECORD))


def close_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """(na, va, nb, vb): all pairs of names of one kind, phase and side that are one edit apart, or two if both have seven letters or more."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            keys = [block_keys(v) for v in x["v"]]
            n = [len(k) for k in keys]
            yield pd.DataFrame({c: x[c].repeat(n).to_numpy() for c in ("nid", "v", "cell")} | {"block": [k for ks in keys for k in ks]})

    def side_of(parts: DataFrame, n: str) -> DataFrame:
        names = spread(parts.select("nid", "v", F.xxhash64("kind", "phase", "side").alias("cell")).distinct())
        keys = names.mapInPandas(keyed, "nid bigint, v string, cell bigint, block bigint")
        return keys.select(F.xxhash64("cell", "block").alias("at"), F.col("nid").alias(f"n{n}"), F.col("v").alias(f"v{n}"))

    # The lengths tell most pairs apart before the edits are counted.
    lengths = F.abs(F.length("va") - F.length("vb"))
    met = side_of(a, "a").join(side_of(b, "b").hint("merge"), "at").filter((lengths <= 2) & (F.levenshtein("va", "vb", 2) >= 0)).select("na", "va", "nb", "vb").distinct()
    edits = F.levenshtein("va", "vb")
    return met.filter((edits <= 1) | (F.least(F.length("va"), F.length("vb")) >= 7))


def _placed(parts: DataFrame, rows: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """Parts with district and taluka (d, t) of their records, 0 where unknown."""
    ids = parts.select(F.col("id").cast(rows.schema[key].dataType).alias(key)).distinct()
    at = located(rows.join(ids.hint("merge"), key, "left_semi"), places, key).select(F.col(key).cast("string").alias("id"), "d", "t")
    return parts.join(at.hint("merge"), "id", "left").withColumns({"d": F.coalesce("d", F.lit(0)), "t": F.coalesce("t", F.lit(0))})


def _dice(a, b):
    """Dice of the letter pairs of two names."""
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))
    return 2 * F.size(F.array_intersect(grams(a), grams(b))) / (F.size(grams(a)) + F.size(grams(b)))


def link(projects: DataFrame, tenders: DataFrame, places: DataFrame) -> DataFrame:
    """(project_id, row_id, score, confidence, cost_known) for pairs that are for the same work.

    Kind of work, phase and side must be equal, districts and talukas equal or unknown, the estimate (where both are
    known; 0 is unknown) within COST_FROM to COST_TO of the approved or revised cost. Place names may differ by one edit,
    longer ones by two. Records without a place or kind of work in any title match nothing. Whole-row repeats count once;
    every listing of a tender counts. No pair is dropped for its number of partners.
    """
    projects, tenders = projects.dropDuplicates(["id"]), tenders.dropDuplicates(["row_id"])
    p, t = cut(project_parts(projects)), cut(tender_parts(tenders))
    pairs = cut(close_names(p, t))
    office = F.regexp_replace("mjp_office", "Sub-division", "").alias("location_raw")
    taluka = F.regexp_extract("title_en", r"\b(?:Tal|Taluka|Tq)\b\.?\s*([\wऀ-ॿ. ]+)$", 1).alias("taluka")
    a = p.join(pairs.select(F.col("na").alias("nid"), F.col("va").alias("v")).hint("merge"), ["nid", "v"], "left_semi")
    a = _placed(a, projects.select("id", office, "district", taluka), places, "id")
    b = t.join(pairs.select(F.col("nb").alias("nid"), F.col("vb").alias("v")).hint("merge"), ["nid", "v"], "left_semi")
    b = _placed(b, tenders.select("row_id", "location_raw", "district", "taluka"), places, "row_id")
    a = a.select(F.col("nid").alias("na"), F.col("v").alias("va"), "kind", "phase", "side", F.col("d").alias("da"), F.col("t").alias("ta"), F.col("id").alias("project_id"), "low", "high")
    b = b.select(F.col("nid").alias("nb"), F.col("v").alias("vb"), "kind", "phase", "side", F.col("d").alias("db"), F.col("t").alias("tb"), F.col("id").cast("bigint").alias("row_id"), F.col("low").alias("cost"))
    linked = pairs.join(a.hint("merge"), ["na", "va"]).join(b.hint("merge"), ["nb", "vb", "kind", "phase", "side"])
    linked = linked.filter("(da = 0 OR db = 0 OR da = db) AND (ta = 0 OR tb = 0 OR ta = tb)")
    known = F.col("cost").isNotNull() & F.col("low").isNotNull()
    fits = (F.col("cost") >= F.col("low") * COST_FROM) & (F.col("cost") <= F.col("high") * COST_TO)
    score = (
        WEIGHTS["village"] * _dice(F.col("va"), F.col("vb"))
        + WEIGHTS["district"] * F.when(F.col("da") * F.col("db") != 0, 1.0).otherwise(0.5)
        + WEIGHTS["taluka"] * F.when(F.col("ta") * F.col("tb") != 0, 1.0).otherwise(0.5)
    )
    best = linked.groupBy("project_id", "row_id").agg(F.max(score).alias("score"), F.max(known).alias("cost_known"), F.max(F.coalesce(fits, F.lit(False))).alias("fits"))
    best = cut(best)
    curve = calibrate(best, p, t)
    confidence = F.lit(curve[0])
    for i in range(1, BINS):
        confidence = F.when(F.col("score") * BINS >= i, F.lit(curve[i])).otherwise(confidence)
    return best.filter("fits OR NOT cost_known").select("project_id", "row_id", "score", confidence.alias("confidence"), "cost_known")


def calibrate(pairs: DataFrame, p: DataFrame, t: DataFrame) -> list[float]:
    """Confidence per score bin, from how often costs agree there beyond chance.

    Chance: the share of tenders whose estimate fits a project's cost, from both cost distributions in logarithmic steps.
    """
    step = F.floor(F.log(F.col("low").cast("double")) / F.log(F.lit(1.1))).alias("s")
    hp = {r.s: r["count"] for r in p.filter("low IS NOT NULL").groupBy(step).count().collect()}
    ht = {r.s: r["count"] for r in t.filter("low IS NOT NULL").groupBy(step).count().collect()}
    total = sum(hp.values()) * sum(ht.values())
    chance = sum(n * ht.get(s + k, 0) for s, n in hp.items() for k in (-2, -1, 0, 1)) / total if total else 0.0
    rows = pairs.filter("cost_known").groupBy(F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).alias("bin")).agg(
        F.count("*").alias("n"), F.count_if("fits").alias("k")
    )
    # Half a pair by chance in every bin, so that a bin with few pairs is not sure.
    blocks = [[r.k + 0.5 * chance, r.n + 0.5, [r.bin]] for r in sorted(rows.collect(), key=lambda r: r.bin)]
    merged: list[list] = []
    for b in blocks:
        merged.append(b)
        while len(merged) > 1 and merged[-2][0] / merged[-2][1] > merged[-1][0] / merged[-1][1]:
            last = merged.pop()
            merged[-1] = [merged[-1][0] + last[0], merged[-1][1] + last[1], merged[-1][2] + last[2]]
    at = {i: max(0.0, min(1.0, (k / n - chance) / max(1e-9, 1 - chance))) for k, n, bins in merged for i in bins}
    out, now = [], 0.0
    for i in range(BINS):
        now = at.get(i, now)
        out.append(float(now))
    return out
