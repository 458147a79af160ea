"""Problem 6: groups of records of one tender and the best representative, chosen in consistent bundles.

Groups are connected components over shared keys. A key links its rows through its smallest row, so a key with n rows
costs n edges, and components shrink by alternating star contractions over the distinct edges, cut by checkpoints.

Fields that depend on each other form a bundle and survive together, whole. ``choose_bundles`` is a branch and bound: the
bound takes every bundle's most trusted candidate, which one aggregation with map-side combine gives for all groups (the
root). Where the root breaks no functional dependency the bound is reached and nothing branches; the other groups branch
over the best candidate per distinct value of the bundles that the dependency ties. With the fields' own rules and no
dependency (p6_found) every group ends at its root.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vahini.functions.text import is_filler
from vahini.operators.graph import components


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """(group_id, row_id) of the groups of two or more row_ids.

    Linked are rows with equal (source_portal, source_tender_id), with equal dedupe_hash, or of which one names the
    other in extra_source_ids (["portal:id"] or [{"portal", "id"}]). NULL and blank keys link nothing, a name of a
    record that isn't here links nothing, malformed JSON is empty. Whole-row repeats are one record.
    """
    r = rows.select("row_id", "source_portal", "source_tender_id", "dedupe_hash", "extra_source_ids").dropDuplicates(["row_id"])
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    name = F.concat_ws("\u0001", "source_portal", "source_tender_id")
    own = r.filter(~blank("source_portal") & ~blank("source_tender_id")).select("row_id", name.alias("key"))
    hashes = r.filter(~blank("dedupe_hash")).select("row_id", F.concat(F.lit("h\u0001"), "dedupe_hash").alias("key"))
    texts = F.from_json("extra_source_ids", "array<string>")
    named = r.filter("extra_source_ids IS NOT NULL").select("row_id", F.explode(texts).alias("x"))
    part = lambda k: F.get_json_object("x", f"$.{k}")
    pair = F.when(F.col("x").startswith("{"), F.concat_ws("\u0001", part("portal"), part("id"))).otherwise(F.regexp_replace("x", "^([^:]*):", "$1\u0001"))
    named = named.select("row_id", pair.alias("key")).filter("key IS NOT NULL")
    heads = own.groupBy("key").agg(F.min("row_id").alias("head"))
    direct = own.unionByName(hashes)
    head_of = heads.unionByName(hashes.groupBy("key").agg(F.min("row_id").alias("head")))
    edges = direct.join(head_of, "key").unionByName(named.join(heads, "key")).select(F.col("row_id").alias("a"), F.col("head").alias("b"))
    return components(edges).select(F.col("root").alias("group_id"), F.col("node").alias("row_id"))


@dataclass(frozen=True)
class Bundle:
    """Fields that survive together. ``present``: whether a row has it; ``rank``: greatest wins (before: smallest row_id).

    ``has``: whether the row has a value for each field, if the bundle may be there in part.
    """

    name: str
    fields: tuple[str, ...]
    present: Column
    rank: tuple[Column, ...]
    has: tuple[Column, ...] = ()


def _candidates(members: DataFrame, bundle: Bundle) -> DataFrame:
    """The best row of every distinct value of the bundle in a group."""
    value = F.struct(*bundle.fields)
    order = F.struct(*[r.alias(f"r{i}") for i, r in enumerate(bundle.rank)], (-F.col("row_id")).alias("last"))
    return (
        members.filter(bundle.present)
        .select("group_id", "row_id", value.alias("value"), order.alias("order"))
        .groupBy("group_id", F.to_json("value").alias("shown"))
        .agg(F.max("order").alias("order"))
    )


def _root(members: DataFrame, bundles: list[Bundle]) -> DataFrame:
    """(group_id, field, row_id): every bundle's most trusted row, dependencies aside; no row without a value."""
    order = lambda b: [*[r.alias(f"r{i}") for i, r in enumerate(b.rank)], (-F.col("row_id")).alias("last"), *[h.alias(f"h{i}") for i, h in enumerate(b.has)]]
    best = members.groupBy("group_id").agg(*[F.max(F.when(b.present, F.struct(*order(b)))).alias(b.name) for b in bundles])
    row = lambda b, i: F.when(F.col(b.name)[f"h{i}"] if b.has else F.lit(True), -F.col(b.name)["last"])
    cells = F.array(*[F.struct(F.lit(f).alias("field"), row(b, i).alias("row_id")) for b in bundles for i, f in enumerate(b.fields)])
    return best.select("group_id", F.explode(cells).alias("c")).select("group_id", "c.*").filter("row_id IS NOT NULL")


@dataclass(frozen=True)
class Dependency:
    """A value of ``given`` fixes the value of ``then``: pairs that contradict ``known`` (given, then) can't stand together."""

    given: str
    then: str


def choose_bundles(members: DataFrame, bundles: list[Bundle], known: DataFrame | None = None, dependency: Dependency | None = None) -> DataFrame:
    """(group_id, field, row_id): the bundles of greatest trust, under a functional dependency between two of them if there is one.

    ``known`` holds the pairs (given, then) that are right, in lower case; a value it doesn't name contradicts nothing. Trust is the
    position among the candidates (1 is best, summed over both bundles; of equal sums the better given one), and leaving a bundle
    without a value costs more than any candidate. Branches whose bound is not below the best found are cut.
    """
    root = _root(members, bundles)
    if dependency is None:
        return root
    by = {f: b for b in bundles for f in b.fields}
    first, second = by[dependency.given], by[dependency.then]

    def ranked(b: Bundle, field: str) -> DataFrame:
        c = _candidates(members, b).withColumn("v", F.lower(F.trim(F.get_json_object("shown", f"$.{field}"))))
        # Only the best row of each value that matters for the dependency can be chosen.
        return c.groupBy("group_id", "v").agg(F.max("order").alias("order"))

    a, b = ranked(first, dependency.given), ranked(second, dependency.then)
    best_a = a.groupBy("group_id").agg(F.max_by("v", "order").alias("va"))
    best_b = b.groupBy("group_id").agg(F.max_by("v", "order").alias("vb"))
    right = known.select(F.lower(F.trim(dependency.given)).alias("va"), F.lower(F.trim(dependency.then)).alias("vb")).distinct()
    named = right.groupBy("va").agg(F.collect_set("vb").alias("allowed"))  # the districts of one taluka
    broken = best_a.join(best_b, "group_id").join(named, "va").filter(~F.array_contains("allowed", F.col("vb"))).select("group_id")
    both = a.withColumn("bundle", F.lit(0)).unionByName(b.withColumn("bundle", F.lit(1))).join(broken, "group_id", "left_semi")
    both = both.join(named.withColumnRenamed("va", "v"), "v", "left").withColumn("row", -F.col("order.last"))
    both = both.withColumn("order_text", F.to_json("order")).select(
        "group_id", "bundle", "v", "row", "allowed", F.row_number().over(_window()).alias("place")
    )  # the window holds the distinct values of one bundle in one group

    fields = (first.fields, second.fields)

    def branch(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf[pdf["bundle"] == 0].sort_values("place")
        right_ = pdf[pdf["bundle"] == 1].sort_values("place")
        lefts = [*zip(left["place"], left["v"], left["row"], left["allowed"]), (len(pdf) + 1, None, None, None)]
        rights = [*zip(right_["place"], right_["v"], right_["row"]), (len(pdf) + 1, None, None)]
        best, chosen = float("inf"), (None, None)
        for pa, va, ra, allowed in lefts:
            if pa + 1 >= best:
                break  # the bound: the best partner costs at least 1
            for pb, vb, rb in rights:
                if pa + pb >= best:
                    break
                if va is None or allowed is None or vb is None or vb in set(allowed):
                    best, chosen = pa + pb, (ra, rb)
                    break
        gid = pdf["group_id"].iloc[0]
        rows = [(gid, f, r) for fs, r in zip(fields, chosen) for f in fs]
        return pd.DataFrame(rows, columns=["group_id", "field", "row_id"]).astype({"row_id": "Int64"})

    fixed = both.groupBy("group_id").applyInPandas(branch, "group_id bigint, field string, row_id bigint")
    touched = [*first.fields, *second.fields]
    kept = root.join(broken.select("group_id", F.explode(F.array(*map(F.lit, touched))).alias("field")), ["group_id", "field"], "left_anti")
    return kept.unionByName(fixed.filter("row_id IS NOT NULL"))


def _window():
    from pyspark.sql import Window

    return Window.partitionBy("group_id", "bundle").orderBy(F.col("order").desc())


def tender_members(rows: DataFrame, portals: DataFrame) -> DataFrame:
    """The grouped rows with group_id and the portal's trust (an unknown portal is the least trusted)."""
    groups = duplicate_groups(rows)
    trust = portals.select("source_portal", "trust_rank").dropDuplicates(["source_portal"])
    columns = ["row_id", "source_portal", "description", "estimated_value_inr", "emd_inr", "bid_submission_end", "status", "district", "taluka", "last_seen_at"]
    one = rows.select(*columns).dropDuplicates(["row_id"])
    return one.join(groups, "row_id").join(trust, "source_portal", "left").withColumn("trust_rank", F.coalesce("trust_rank", F.lit(2**31 - 1)))


def tender_bundles() -> list[Bundle]:
    seen = F.coalesce(F.unix_micros("last_seen_at"), F.lit(-(2**62)))
    text = lambda c: ~is_filler(F.col(c))
    amount = lambda c: F.coalesce(F.col(c) != 0, F.lit(False))
    trusted = (-F.col("trust_rank"), seen)
    return [
        Bundle("description", ("description",), text("description"), (F.length(F.trim("description")), seen)),
        Bundle("estimated_value_inr", ("estimated_value_inr",), amount("estimated_value_inr"), trusted),
        Bundle("emd_inr", ("emd_inr",), amount("emd_inr"), trusted),
        Bundle("bid_submission_end", ("bid_submission_end",), text("bid_submission_end"), (seen,)),
        Bundle("status", ("status",), text("status"), (seen,)),
        Bundle("district", ("district",), text("district"), (seen,)),
    ]


AMOUNTS = ("estimated_value_inr", "emd_inr")


def tender_survivors(rows: DataFrame, portals: DataFrame) -> DataFrame:
    return choose_bundles(tender_members(rows, portals), tender_bundles())


def consistent_tenders(rows: DataFrame, portals: DataFrame, places: DataFrame) -> DataFrame:
    """As ``tender_survivors``, but the two amounts are one bundle (the row with more of them, then as one alone), and the
    taluka survives besides, taluka and district never contradicting the reference list."""
    seen = F.coalesce(F.unix_micros("last_seen_at"), F.lit(-(2**62)))
    has = tuple(F.coalesce(F.col(c) != 0, F.lit(False)) for c in AMOUNTS)
    money = Bundle("amounts", AMOUNTS, has[0] | has[1], (has[0].cast("int") + has[1].cast("int"), -F.col("trust_rank"), seen), has)
    bundles = [*[b for b in tender_bundles() if b.name not in AMOUNTS], money, Bundle("taluka", ("taluka",), ~is_filler(F.col("taluka")), (seen,))]
    known = places.filter("taluka IS NOT NULL").select("taluka", "district")
    return choose_bundles(tender_members(rows, portals), bundles, known, Dependency("taluka", "district"))
