"""Tables written once in the folder that driver and executors share, so that what follows survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own, and a cluster fails: its executors
    could not read a folder of the driver's machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(spark, "_evalfold_dir", None)
    if own is None:
        own = spark._evalfold_dir = tempfile.mkdtemp(prefix="evalfold-")
    return own


def _folder(spark: SparkSession):
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one."""
    return f"{shared_dir(spark)}/evalfold-{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes `df` once as Parquet in the shared folder and reads it back.

    This cuts the lineage at a place that outlives any executor, keeps the columns compressed and prunable, and lets
    later joins shuffle both of their sides (so that adaptive execution can split a hot key). The table stays until
    `clear_staged`, or until the application ends.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    if getattr(spark, "_evalfold_clears", None) != spark.sparkContext.applicationId:
        folder, files = _folder(spark)
        files.deleteOnExit(folder)
        spark._evalfold_clears = spark.sparkContext.applicationId
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> None:
    """Deletes the tables that this application's `staged` left in the shared folder; results not yet written need them."""
    folder, files = _folder(spark)
    files.delete(folder, True)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
