"""What changed between consecutive full snapshots.

Rows become (bucket, snapshot, key hash, row hash) with 128-bit keys; a bucket holds every snapshot of its keys and
about ``BUCKET_ROWS`` rows, so no group grows with the data and a hot attribute value doesn't matter (buckets hang on
the unique key). In a bucket numpy sorts each snapshot and takes set differences by ``searchsorted``; full values are
read for the keys that differ, behind the join with these.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_ROWS = 200_000


def _diff(snap: np.ndarray, key: np.ndarray, rest: np.ndarray, late: np.ndarray, row: np.ndarray, first: int, last: int) -> pd.DataFrame:
    """Changes of one bucket. ``key``/``rest``: the two halves of the key's hash; the latest row of a key counts."""
    kind = np.dtype([("k", "i8"), ("r", "i8")])
    both = np.empty(len(key), kind)
    both["k"], both["r"] = key, rest
    order = np.lexsort((row, late, rest, key, snap))
    snap, both, row = snap[order], both[order], row[order]
    final = np.ones(len(snap), bool)
    final[:-1] = (snap[1:] != snap[:-1]) | (both[1:] != both[:-1])
    snap, both, row = snap[final], both[final], row[final]
    out = []
    for s in range(first + 1, last + 1):
        a0, a1, b1 = np.searchsorted(snap, [s - 1, s, s + 1])
        old, new, old_row, new_row = both[a0:a1], both[a1:b1], row[a0:a1], row[a1:b1]
        # Both are sorted by (k, r); k alone is searched, r settles the rare equal halves.
        at = _find(old, new)
        there = at >= 0
        changed = np.zeros(len(new), bool)
        changed[there] = old_row[at[there]] != new_row[there]
        gone = _find(new, old) < 0
        for what, keys in (("added", new[~there]), ("changed", new[changed]), ("removed", old[gone])):
            out.append((s, what, keys))
    every = np.concatenate([k for _, _, k in out]) if out else np.empty(0, kind)
    lengths = [len(k) for _, _, k in out]
    # One column of Python strings: pieces put together by pandas would be a chunked array, which Spark does not take.
    kinds = pd.Series([w for (_, w, _), n in zip(out, lengths) for _ in range(n)], dtype=object)
    return pd.DataFrame({"snapshot_id": np.repeat([s for s, _, _ in out], lengths).astype("i4"), "k": every["k"], "r": every["r"], "change_kind": kinds})


def _find(within: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in a sorted array, -1 where it isn't."""
    at = np.searchsorted(within["k"], keys["k"])
    out = np.full(len(keys), -1)
    todo = np.arange(len(keys))
    while len(todo):
        at_ = at[todo]
        inside = at_ < len(within)
        todo, at_ = todo[inside], at_[inside]
        same = within["k"][at_] == keys["k"][todo]
        todo, at_ = todo[same], at_[same]
        hit = within["r"][at_] == keys["r"][todo]
        out[todo[hit]] = at_[hit]
        todo = todo[~hit]
        at[todo] += 1
    return out


def snapshot_changes(
    df: DataFrame, snapshot: str, key: dict[str, Column], late: Column, values: list[Column], carry: dict[str, Column] | None = None
) -> DataFrame:
    """(snapshot_id, *key, change_kind, *carry) for every added, removed or changed key between consecutive snapshots.

    ``key`` and ``values`` are normalised expressions; NULL equals NULL and differs from every value. A key that comes
    more than once counts with its row latest by ``late`` (NULL is earliest, then the greater row hash). A key with a
    NULL part is a key like any other; rows without a snapshot are left out. The snapshots are the integers from the
    least to the greatest; a missing one is an empty delivery. ``carry``: columns of the row that counts, of the
    snapshot itself or, for a removed key, of the one before.
    """
    carry = carry or {}
    text = [F.to_json(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]), {"ignoreNullFields": "false"})]
    rows = df.filter(F.col(snapshot).isNotNull()).select(
        F.col(snapshot).cast("int").alias("snapshot_id"), *[c.alias(f"k_{n}") for n, c in key.items()],
        F.coalesce(late, F.lit(-(2**62))).cast("long").alias("late"), F.xxhash64(*text).alias("row"), *[c.alias(f"c_{n}") for n, c in carry.items()],
    )
    whole = F.to_json(F.struct(*[F.col(f"k_{n}").alias(n) for n in key]), {"ignoreNullFields": "false"})
    rows = rows.withColumn("k", F.xxhash64(whole)).withColumn("r", F.xxhash64(F.lit("r"), whole))
    size = df.agg(F.count("*"), F.min(snapshot), F.max(snapshot)).first()
    buckets = max(1, -(-int(size[0] or 0) // BUCKET_ROWS))
    first, last = int(size[1] or 0), int(size[2] or 0)

    def diff(pdf: pd.DataFrame) -> pd.DataFrame:
        a = {c: pdf[c].to_numpy() for c in ("snapshot_id", "k", "r", "late", "row")}
        return _diff(a["snapshot_id"], a["k"], a["r"], a["late"], a["row"], first, last)

    # Repeats within a bucket are dropped before they travel.
    compact = rows.select(F.pmod("k", F.lit(buckets)).alias("bucket"), "snapshot_id", "k", "r", "late", "row")
    changed = compact.groupBy("bucket").applyInPandas(diff, "snapshot_id int, k bigint, r bigint, change_kind string")
    changed = changed.withColumn("at", F.when(F.col("change_kind") == "removed", F.col("snapshot_id") - 1).otherwise(F.col("snapshot_id")))
    # Full values are read for the differing keys only; which of a key's rows counts matters for the carried columns alone.
    full = [f"k_{n}" for n in key] + [f"c_{n}" for n in carry]
    rank = ["late", "row"] if carry else []
    met = changed.join(rows.select(F.col("snapshot_id").alias("at"), "k", "r", *full, *rank), ["at", "k", "r"])
    one = F.max_by(F.struct(*full), F.struct(*rank)) if carry else F.first(F.struct(*full))
    return met.groupBy("at", "k", "r", "snapshot_id", "change_kind").agg(one.alias("full")).select(
        "snapshot_id", *[F.col(f"full.k_{n}").alias(n) for n in key], "change_kind", *[F.col(f"full.c_{n}").alias(n) for n in carry]
    )
