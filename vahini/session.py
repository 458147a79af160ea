"""Session helpers: checkpoints in the shared folder, table reading, partition counts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: From this size a task on, an input has tasks enough by itself.
TASK_BYTES = 128 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names in ``spark.checkpoint.dir``.

    Only where neither the context nor the session names one (tests, notebooks in local mode) is a
    temporary folder set; on a cluster such a folder would not be shared, so there an error is raised.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY, None)
    if named:
        sc.setCheckpointDir(named)
        return
    if not sc.master.startswith("local["):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="vahini-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: written to the shared checkpoint folder, read back from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def spread(df: DataFrame) -> DataFrame:
    """Round-robin an input of an expensive per-row stage that is too small to have a task for every core.

    A small compressed file arrives as one task, and AQE puts small shuffles together into one, which would leave the
    cores idle. The sizes of the tables and checkpoints it is read from tell, without running anything (the optimiser's
    size of a join is the product of its sides); larger inputs, and those of unknown size, pass unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df if size >= cores * TASK_BYTES else df.repartition(2 * cores)
