"""Queries of the general problems: 3 (timestamps) and 7 (snapshots)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vahini.functions.dates import instant_us
from vahini.functions.text import squeeze
from vahini.operators.snapshots import snapshot_changes
from vahini.operators.timestamps import normalise_timestamps
from vahini.queries import instants_sql
from vahini.session import table


def timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenders = normalise_timestamps(
        table(spark, sf_dir, "tenders"), "row_id",
        {"publish_date": "+05:30", "bid_submission_end": "+05:30", "first_seen_at": F.col("crawler_zone")},
        F.col("source_portal"), ["loaded_at"], "tenders",
    )
    awards = normalise_timestamps(table(spark, sf_dir, "awards"), "id", {"award_date": "+05:30"}, F.lit("awards"), [], "awards")
    return tenders.unionByName(awards)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps(spark, sf_dir).filter("rule").select("table_name", "row_key", "field_name", "ts_us")


def p3_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each format occurs, and how many values can only be read against the conventions."""
    return (
        timestamps(spark, sf_dir)
        .groupBy("table_name", "field_name", "fmt")
        .agg(F.count("*").alias("n_values"), F.count_if(~F.col("rule")).alias("n_against_rule"))
    )


def changes(spark: SparkSession, sf_dir: str, carry: tuple[str, ...] = ()) -> DataFrame:
    text = lambda c: F.nullif(F.lower(squeeze(F.col(c))), F.lit(""))
    return snapshot_changes(
        table(spark, sf_dir, "tender_snapshots"),
        "snapshot_id",
        {"source_portal": F.col("source_portal"), "source_tender_id": F.upper(F.trim("source_tender_id"))},
        F.unix_micros("last_seen_at"),
        [text("title"), text("status"), F.col("estimated_value_inr"), instant_us(F.col("bid_submission_end"))],
        {c: text(c) for c in carry},
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir).select("snapshot_id", "source_portal", "source_tender_id", "change_kind")


def p7_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir, ("status",)).groupBy("snapshot_id", "change_kind", "status").agg(F.count("*").alias("n_changes"))


ORACLE_SQL: dict[str, str] = {"p3_found": instants_sql.P3_FOUND, "p3_formats": instants_sql.P3_FORMATS, "p7_found": instants_sql.P7_FOUND, "p7_change_counts": instants_sql.P7_COUNTS}

QUERIES = {"p3_found": p3_found, "p3_formats": p3_formats, "p7_found": p7_found, "p7_change_counts": p7_change_counts}
