"""Record tables: strict manifests, content-addressed records, insert-if-absent caches."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version int, pools map<string, struct<train: array<string>, val: array<string>, test: array<string>>>, historical_pass_rates map<string, double>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(pool_key, role, pos, task_id) of a JSON manifest; anything that isn't its schema fails."""
    raw = spark.read.schema(MANIFEST).json(path, multiLine=True, mode="FAILFAST")
    pools = raw.select(F.explode("pools").alias("pool_key", "roles"))
    roles = F.array(*(F.struct(F.lit(r).alias("role"), F.col(f"roles.{r}").alias("ids")) for r in ("train", "val", "test")))
    return pools.select("pool_key", F.explode(roles).alias("r")).select("pool_key", "r.role", F.posexplode("r.ids").alias("pos", "task_id"))


def manifest_conflicts(members: DataFrame) -> DataFrame:
    """Task ids that occur twice in a pool, in one role or in two."""
    by = members.groupBy("pool_key", "task_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("role")).alias("roles"))
    return by.filter("n > 1")


def content_hash(*columns: str):
    """SHA-256 of the columns as compact JSON with sorted names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))).cast("binary"), 256)


def put_records(new: DataFrame, stored: DataFrame | None, path: str) -> DataFrame:
    """Writes the records whose content_hash isn't stored yet, each once, and returns what was written."""
    once = new.dropDuplicates(["content_hash"])
    fresh = once if stored is None else once.join(stored.select("content_hash"), "content_hash", "left_anti")
    fresh.write.mode("append").parquet(path)
    return fresh


def get_records(refs: DataFrame, stored: DataFrame, schema_name: str) -> DataFrame:
    """The records that (content_hash, schema) refs point to, with `problem` where there is none or of another schema."""
    found = refs.join(stored.withColumnRenamed("schema", "stored_schema"), "content_hash", "left")
    problem = F.when(F.col("stored_schema").isNull(), "absent").when(F.col("stored_schema") != schema_name, "other schema")
    return found.withColumn("problem", problem)


#: Names of a log's entries, and of those that a writer hasn't finished.
ENTRY, TEMPORARY = r"entry-[0-9A-Za-z_-]+\.json", r"\.?_?tmp-.*|\.entry-.*\.crc"


def _names(spark: SparkSession, path: str) -> list[str]:
    """The log's entries; anything else in its folder but unfinished entries fails."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    if foreign := [n for n in names if not re.fullmatch(f"{ENTRY}|{TEMPORARY}", n)]:
        raise ValueError(f"not entries of a log: {sorted(foreign)}")
    return [n for n in names if re.fullmatch(ENTRY, n)]


def scan_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of a log's entries (one JSON document each), with `entry`, its name, by which and by `at` they are ordered.

    A foreign file or a torn entry fails; unfinished entries are passed over. A log that isn't there is empty.
    """
    names = _names(spark, path)
    if not names:
        return spark.createDataFrame([], f"{schema}, entry string")
    rows = spark.read.schema(schema).json([f"{path}/{n}" for n in names], mode="FAILFAST", multiLine=True)
    return rows.withColumn("entry", F.element_at(F.split(F.input_file_name(), "/"), -1)).orderBy("at", "entry")


def truncate_log(spark: SparkSession, path: str) -> None:
    """Deletes a log's entries, after all names in its folder were checked; a foreign file keeps everything."""
    _names(spark, path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def insert_absent(new: DataFrame, cache: DataFrame) -> DataFrame:
    """`cache` with the keys of `new` (key, at, value) that it lacks: the earliest writer of a key wins, and stays."""
    first = new.groupBy("key").agg(F.min(F.struct("at", "value")).alias("f")).select("key", "f.at", "f.value")
    return cache.unionByName(first.join(cache.select("key"), "key", "left_anti"))
