"""Landed JSON state (records keyed by id, overlays, registries) as tables, and the sinks that write it back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vahini.functions.text import safe_cell
from vahini.session import ensure_checkpoint_dir

SEEN = "map<string,struct<title:string,ref_no:string,closing:string,opening:string,published:string,org_chain:string,source:string,first_seen:string>>"
DETAILS = "map<string,map<string,string>>"


def keyed_records(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """A JSON document {key: record} as rows (key, record fields); a missing or malformed document gives no rows."""
    try:
        text = spark.read.text(path, wholetext=True)
    except Exception as e:  # the path isn't there
        if "PATH_NOT_FOUND" not in str(e):
            raise
        text = spark.createDataFrame([], "value string")
    rows = text.select(F.explode(F.from_json("value", schema)).alias(key, "record"))
    return rows.select(key, "record.*") if schema.startswith("map<string,struct") else rows


def overlay(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """Rows by key, those of ``over`` before those of ``base``."""
    return over.unionByName(base.join(over.select(key), key, "left_anti"), allowMissingColumns=True)


def first_known(*columns: Column) -> Column:
    """The first that is neither NULL nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def canonical_tenders(live: DataFrame, seen: DataFrame, details: DataFrame, awarded: DataFrame) -> DataFrame:
    """One row per tender id of any source, each field from live, else seen, else the page's captions; status by what is known.

    live and seen: (id, title, closing, published, org_chain); details: (id, record map); awarded: (id). A tender that is
    live is "live", else one with an award "awarded", else one with a closing time "closed", else "unknown".
    """
    side = lambda df, p: df.select("id", *[F.col(c).alias(f"{p}_{c}") for c in ("title", "closing", "published", "org_chain")], F.lit(True).alias(f"in_{p}"))
    won = awarded.select("id").distinct().withColumn("in_award", F.lit(True))
    all_ids = side(live, "live").join(side(seen, "seen"), "id", "full_outer").join(won, "id", "full_outer").join(details.select("id", "record"), "id", "left")
    caption = lambda k: F.col("record")[k]
    both = lambda c, k: first_known(F.col(f"live_{c}"), F.col(f"seen_{c}"), caption(k))
    closing = both("closing", "Bid Submission End Date")
    status = F.when(F.col("in_live"), "live").when(F.col("in_award"), "awarded").when(closing.isNotNull(), "closed").otherwise("unknown")
    return all_ids.select(
        "id", both("title", "Title").alias("title"), closing.alias("closing"), both("published", "Published Date").alias("published"),
        both("org_chain", "Organisation Chain").alias("org_chain"), caption("Location").alias("location"), status.alias("status"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    """All cells quoted, none that a spreadsheet would run; header included."""
    safe = df.select(*[safe_cell(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
    safe.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON lines, keys sorted, under its name; a job's files appear together when it commits."""
    for name, df in sorted(tables.items()):
        df.select(*sorted(df.columns)).write.mode("overwrite").json(f"{path}/{name}")


def nested_feed(parent: DataFrame, children: dict[str, DataFrame], key: str, order: dict[str, str]) -> DataFrame:
    """Parents with their children as sorted arrays of structs, [] where there are none. Children of a parent are few."""
    out = parent
    for name, df in children.items():
        cols = [c for c in df.columns if c != key]
        first = order[name]
        nested = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(first, *[c for c in cols if c != first]))).alias(name))
        kind = nested.schema[name].dataType
        out = out.join(nested, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out


def parts_by_size(files: DataFrame, by: str, order: str, size: str, most: int) -> DataFrame:
    """Add ``part``: a new one begins where the running size would pass ``most`` (a single larger file is a part of its own)."""
    listed = files.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, size))).alias("fs"))
    step = lambda acc, f: F.when(
        (acc["used"] > 0) & (acc["used"] + f[size] > most),
        F.struct((acc["part"] + 1).alias("part"), f[size].cast("bigint").alias("used"), F.concat(acc["out"], F.array(acc["part"] + 1)).alias("out")),
    ).otherwise(F.struct(acc["part"].alias("part"), (acc["used"] + f[size]).cast("bigint").alias("used"), F.concat(acc["out"], F.array(acc["part"])).alias("out")))
    start = F.struct(F.lit(1).alias("part"), F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("out"))
    parts = listed.select(by, "fs", F.aggregate("fs", start, step, lambda a: a["out"]).alias("parts"))
    return parts.select(by, F.explode(F.arrays_zip("fs", "parts")).alias("z")).select(by, f"z.fs.{order}", f"z.fs.{size}", F.col("z.parts").alias("part"))


def csv_line(*columns: str) -> Column:
    """The columns as one line: every cell quoted, none that a spreadsheet would run, '' for NULL."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(safe_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.concat_ws(",", *[cell(c) for c in columns])


class RunLog:
    """An append-only log of runs in the shared folder; a run that is written again (a retry) replaces its own part."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        ensure_checkpoint_dir(spark)
        self.spark, self.path = spark, path or f"{spark.sparkContext.getCheckpointDir()}/runs-{uuid.uuid4().hex}"

    def append(self, rows: DataFrame, run: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/run_no={run}")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("run_no")
