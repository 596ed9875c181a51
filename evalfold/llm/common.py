"""What the operators of this subpackage share: reading tables, small Arrow batches, tables staged in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from evalfold.sources.staging import clear_staged, free_name, shared_dir, staged  # noqa: F401


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` under `sf_dir`, read by Spark (so any path that Spark can open works)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch: texts are long, so Spark's usual 10,000 would hold much of a task's input in several copies at once.
BATCH_ROWS = 1000
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, after lowering its session's Arrow batches to BATCH_ROWS rows where they are larger. Spark reads the setting when a
    result is planned, so it stays until the end of a `workspace`."""
    if not 0 < int(df.sparkSession.conf.get(_BATCHES)) <= BATCH_ROWS:
        df.sparkSession.conf.set(_BATCHES, str(BATCH_ROWS))
    return df


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Use operators and write their results inside; at the end the staged tables go and the Arrow setting is as it was."""
    was = spark.conf.get(_BATCHES)
    try:
        yield
    finally:
        spark.conf.set(_BATCHES, was)
        clear_staged(spark)
