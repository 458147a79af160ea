"""Keyed writes as joins: the old table and a batch give the new table.

Keys compare null-safely where ``null_safe`` says so. A batch with several rows of a key counts with its last by
``order`` (then the greatest remaining columns). Columns that clash in name are told apart by the side they come from.
Everything is one shuffle on the key, whatever the number of kept or merged columns.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_per_key(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last by ``order``; ties by all columns, so the result doesn't hang on the input order."""
    rest = [c for c in batch.columns if c not in keys]
    rank = F.struct(*[F.col(c) for c in order], *[F.to_json(F.struct(*rest))] if rest else [])
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("row_")).select(*keys, "row_.*") if rest else batch.distinct()


def _joined(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    o = old.select(F.struct(*old.columns).alias("o"))
    n = new.select(F.struct(*new.columns).alias("n"))
    on = None
    for k in keys:
        same = F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
        on = same if on is None else on & same
    return o.join(n, on, "full_outer")


def merge_upsert(
    old: DataFrame, batch: DataFrame, keys: list[str], keep_first: list[str] = (), keep_if_blank: list[str] = (), union: list[str] = (),
    count: str | None = None, order: list[str] = (),
) -> DataFrame:
    """The table after the batch: new rows are added, known keys take the batch's columns.

    ``keep_first`` columns keep the old value where there is one; ``keep_if_blank`` keep it where the batch has NULL or
    ''; ``union`` (arrays) become the sorted union; ``count`` goes up by one per write. NULL keys are a key.
    """
    new = last_per_key(batch, keys, list(order))
    both = _joined(old, new, keys)
    out: list[Column] = []
    for c in old.columns:
        was, now = F.col(f"o.{c}"), F.col(f"n.{c}") if c in new.columns else F.lit(None)
        there = F.col("n").isNotNull()
        if c == count:
            value = F.coalesce(was, F.lit(0)) + there.cast("int")
        elif c in keys:
            value = F.when(F.col("o").isNotNull(), was).otherwise(now)
        elif c in keep_first:
            value = F.coalesce(was, now)
        elif c in keep_if_blank:
            value = F.coalesce(F.when(F.trim(now.cast("string")) != "", now), was, now)
        elif c in union:
            empty = F.array().cast(old.schema[c].dataType)
            value = F.array_sort(F.array_union(F.coalesce(was, empty), F.coalesce(now, empty)))
        elif c in new.columns:
            value = F.when(there, now).otherwise(was)
        else:
            value = was
        out.append(value.alias(c))
    return both.select(*out)


def insert_or_ignore(old: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and of the batch those with a key that isn't there (one per key). NULL equals NULL."""
    return old.unionByName(new_rows(old, last_per_key(batch, keys, []), keys), allowMissingColumns=True)


def insert_or_replace(old: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The batch (one per key), and the old rows whose key isn't in it."""
    new = last_per_key(batch, keys, [])
    return new_rows(new, old, keys).unionByName(new, allowMissingColumns=True)


def new_rows(old: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the batch with a key that ``old`` doesn't have; NULL equals NULL."""
    known = old.select(*[F.col(k).alias(f"old_{i}_") for i, k in enumerate(keys)]).distinct()
    on = None
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"old_{i}_"))
        on = same if on is None else on & same
    return batch.join(known, on, "left_anti")


def append_events(log: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Only what is to be appended: events not logged yet, repeats within the batch once."""
    return new_rows(log, last_per_key(batch, keys, []), keys)


def override(auto: DataFrame, decisions: DataFrame, keys: list[str], column: str) -> DataFrame:
    """People's decisions before automatic values; NULL decisions decide nothing."""
    d = decisions.filter(F.col(column).isNotNull()).select(*keys, F.col(column).alias("decided_")).dropDuplicates(keys)
    return auto.join(d, keys, "left").withColumn(column, F.coalesce("decided_", column)).drop("decided_")


def with_previous(old: DataFrame, batch: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The batch's values of a column with what they were before (``previous``, NULL for new keys)."""
    return batch.select(*keys, column).join(old.select(*keys, F.col(column).alias("previous")), keys, "left")


def keep_last_good(old: DataFrame, read, keys: list[str], **how) -> tuple[DataFrame, str | None]:
    """(table, error): ``merge_upsert`` with what ``read()`` gives; the table as it was and the error's kind if it can't be read.

    Only the reading is guarded (a missing or unreadable source); its rows are not run here.
    """
    try:
        batch = read()
    except AnalysisException as e:
        return old, e.getCondition() or "unreadable"
    return merge_upsert(old, batch, keys, **how), None


def merge_parses(rows: DataFrame, key: str, order: str, fields: list[str], union: str) -> DataFrame:
    """Several readings of one record as one: the first known value of every field in order, and the sorted union of ``union``.

    Blank texts are not known. The readings of one record are few; nothing but the union's distinct values is kept of them.
    """
    known = lambda c: F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    return rows.groupBy(key).agg(*[F.min_by(c, F.when(known(c), F.col(order))).alias(c) for c in fields], F.array_sort(F.collect_set(F.when(known(union), F.col(union)))).alias(f"all_{union}"))
