"""What is to be delivered, and what has been: events with stable keys, parts, and the ledger they are matched against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vahini.operators.upsert import new_rows


def event_keys(rows: DataFrame, key: str, kinds: dict[str, Column]) -> DataFrame:
    """(key, kind, event_key) per kind whose value is known: "kind:key:value", the same as long as the value is."""
    cells = F.array(*[F.struct(F.lit(n).alias("kind"), F.concat_ws(":", F.lit(n), F.col(key), v.cast("string")).alias("event_key"), v.isNotNull().alias("there")) for n, v in kinds.items()])
    return rows.select(key, F.explode(cells).alias("c")).filter("c.there").select(key, "c.kind", "c.event_key")


def pending(due: DataFrame, delivered: DataFrame, keys: list[str]) -> DataFrame:
    """What is due and not in the ledger yet; NULL equals NULL, repeats are due once."""
    return new_rows(delivered, due.dropDuplicates(keys), keys)


def completed(parts: DataFrame, delivered: DataFrame, event: str, part: str) -> DataFrame:
    """(event, n_parts, n_delivered, done) per event: done when every part is in the ledger."""
    sent = delivered.select(event, part).distinct().withColumn("sent_", F.lit(True))
    return parts.select(event, part).distinct().join(sent, [event, part], "left").groupBy(event).agg(
        F.count("*").alias("n_parts"), F.count("sent_").alias("n_delivered"), F.bool_and(F.col("sent_").isNotNull()).alias("done")
    )


def mode(events: DataFrame, digest_delivered: bool) -> DataFrame:
    """Add ``how``: all events of the first run go into one digest; once that is delivered, later ones go alone."""
    return events.withColumn("how", F.lit("single" if digest_delivered else "digest"))
