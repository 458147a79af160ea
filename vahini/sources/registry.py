"""Readers by name: what delivers rows is looked up, so a new source is one more entry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vahini.session import table

TABLES = ("tenders", "tender_snapshots", "tender_events", "contractors", "awards", "mjp_projects", "documents", "place_ref", "portals")


def registry(spark: SparkSession, folder: str) -> dict[str, Callable[[], DataFrame]]:
    """A reader for every registered table of a folder; nothing is read before one is called."""
    return {name: (lambda name=name: table(spark, folder, name)) for name in TABLES}
