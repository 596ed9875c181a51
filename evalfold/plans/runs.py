"""Queries over the records that a run binds, buffers and resumes from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalfold.operators import bindings as B
from evalfold.plans.registry import query
from evalfold.sources.staging import staged
from evalfold.sources.tables import read


def _md5(*parts):
    return F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary"))


@query("""WITH r AS (SELECT o_custkey AS run_id, o_orderkey AS "at", md5(concat_ws('|', o_custkey::VARCHAR, (o_orderkey % 3)::VARCHAR)) AS content_hash FROM orders),
f AS (SELECT run_id, min("at") AS a, arg_min(content_hash, "at") AS bound FROM r GROUP BY run_id)
SELECT run_id, "at", content_hash, bound, CASE WHEN "at" = a THEN 'bound' WHEN content_hash = bound THEN 'same' ELSE 'conflict' END AS outcome FROM r JOIN f USING (run_id)""")
def run_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request to bind a run to its record: the first binds, the same record again changes nothing, another conflicts."""
    o = read(spark, sf_dir, "orders")
    return B.bind(o.select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("at"), _md5(F.col("o_custkey"), F.col("o_orderkey") % 3).alias("content_hash")), ["run_id"], ["at"])


@query("""WITH r AS (SELECT l_orderkey AS run_id, l_linenumber AS step_index, l_partkey AS p, l_suppkey AS s, md5(concat_ws('|', l_returnflag, l_linestatus)) AS content_hash FROM lineitem),
f AS (SELECT run_id, step_index, min((p, s, content_hash)) AS m FROM r GROUP BY ALL)
SELECT run_id, step_index, count(*) AS n_requests, count(*) FILTER (WHERE content_hash <> m[3]) AS n_conflicts FROM r JOIN f USING (run_id, step_index) GROUP BY ALL""".replace("m[3]", "struct_extract(m, 3)"))
def step_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to bind the result of each step, and how many meet another result."""
    r = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("step_index"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), _md5(F.col("l_returnflag"), F.col("l_linestatus")).alias("content_hash"))
    return B.bind(r, ["run_id", "step_index"], ["p", "s"]).groupBy("run_id", "step_index").agg(F.count(F.lit(1)).alias("n_requests"), F.count_if(F.col("content_hash") != F.col("bound")).alias("n_conflicts"))


@query("""SELECT c_custkey AS run_id, CASE WHEN c_custkey % 7 <> 0 THEN 'run ' || c_name END AS run, CASE WHEN c_custkey % 5 <> 0 THEN 'payload ' || c_mktsegment END AS payload,
CASE WHEN c_custkey % 7 = 0 THEN 'run not bound' WHEN c_custkey % 5 = 0 THEN 'payload not bound' WHEN c_custkey % 3 = 0 THEN 'payload of another schema' END AS problem FROM customer WHERE c_custkey % 35 <> 0""")
def launch_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record and the payload that each run was launched with, by its two bindings."""
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    parts = c.select(F.col("c_custkey").alias("run_id"), F.explode(F.array(
        F.when(k % 7 != 0, F.struct(F.lit("run").alias("part"), F.lit("run").alias("schema"), F.concat(F.lit("run "), "c_name").alias("content"))),
        F.when(k % 5 != 0, F.struct(F.lit("payload").alias("part"), F.when(k % 3 == 0, "note").otherwise("payload").alias("schema"), F.concat(F.lit("payload "), "c_mktsegment").alias("content"))),
    )).alias("p")).filter("p IS NOT NULL").select("run_id", "p.*").withColumn("content_hash", _md5(F.col("schema"), F.col("content")))
    records = staged(parts.select("content_hash", "schema", "content").distinct(), "records")
    return B.load_launch(parts.select("run_id", "part", "content_hash"), records)


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber % 4 WHEN 0 THEN 'row_input' WHEN 1 THEN 'join_input' WHEN 2 THEN 'manifest' ELSE 'result' END AS wanted,
CASE WHEN l_partkey % 17 = 0 THEN NULL WHEN l_partkey % 19 = 0 THEN 'note' ELSE CASE l_linenumber % 4 WHEN 0 THEN 'row_input' WHEN 1 THEN 'join_input' WHEN 2 THEN 'manifest' ELSE 'result' END END AS found,
CASE WHEN l_partkey % 17 = 0 THEN 'absent' WHEN l_partkey % 19 = 0 THEN 'other schema' END AS problem FROM lineitem""")
def typed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row inputs, join inputs, manifests and results read by ref: what is there, and whether its schema is the wanted one."""
    n = F.col("l_linenumber") % 4
    wanted = F.when(n == 0, "row_input").when(n == 1, "join_input").when(n == 2, "manifest").otherwise("result")
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), wanted.alias("wanted"), "l_partkey")
    rows = rows.withColumn("schema", F.when(F.col("l_partkey") % 19 == 0, "note").otherwise(F.col("wanted"))).withColumn("content_hash", _md5(F.col("schema"), F.col("l_partkey")))
    stored = staged(rows.filter("l_partkey % 17 <> 0").select("content_hash", "schema").distinct(), "documents")
    return B.typed_documents(rows, stored)


_LOG = """lg AS (SELECT o_custkey AS run_id, o_orderkey % 4 AS step_index, o_orderkey AS "at", CASE WHEN o_orderkey % 3 = 0 THEN 'evict' ELSE 'persist' END AS op, o_orderkey % 5 AS k FROM orders),
la AS (SELECT run_id, step_index, max("at") AS "at", arg_max(op, "at") AS op, arg_max(k, "at") AS k FROM lg GROUP BY ALL),
bu AS (SELECT run_id, step_index, i AS pos, 'intent-' || "at" || '-' || i AS intent FROM la, range(0, 5) AS x(i) WHERE op = 'persist' AND i < k)"""


def _deferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    intents = F.when(key % 5 > 0, F.transform(F.sequence(F.lit(0).cast("long"), key % 5 - 1), lambda i: F.concat(F.lit("intent-"), key.cast("string"), F.lit("-"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    log = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), (key % 4).alias("step_index"), key.alias("at"), F.when(key % 3 == 0, "evict").otherwise("persist").alias("op"), intents.alias("intents"))
    return B.deferred_intents(log)


@query("WITH " + _LOG + " SELECT run_id, step_index, pos, intent FROM bu")
def deferred_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intents that each step of a run holds back now."""
    return _deferred(spark, sf_dir)


@query("WITH " + _LOG + """, rs AS (SELECT DISTINCT o_custkey AS run_id, o_orderkey % 4 AS step_index FROM orders WHERE o_orderstatus <> 'F'),
hd AS (SELECT c_custkey AS run_id, c_custkey % 4 AS step_index FROM customer)
SELECT run_id, max(step_index) AS step_index FROM (SELECT run_id, step_index FROM hd UNION ALL SELECT run_id, step_index - 1 FROM hd WHERE step_index > 0) JOIN rs USING (run_id, step_index) SEMI JOIN bu USING (run_id, step_index) GROUP BY run_id""")
def crash_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step at which each run resumes after a crash between a deferral and its resolution."""
    heads = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), (F.col("c_custkey") % 4).alias("step_index"))
    results = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), (F.col("o_orderkey") % 4).alias("step_index"), F.when(F.col("o_orderstatus") == "F", "STOP").otherwise("CONTINUE").alias("status"), F.lit(0).alias("n_resolved"))
    return B.crash_window(heads, results, _deferred(spark, sf_dir))


@query("""WITH a AS (SELECT l_orderkey AS context, min((l_linenumber, l_partkey, l_suppkey)) AS f, count(*) AS n, count(DISTINCT l_linestatus) AS n_artifacts, arg_min(l_linestatus, (l_linenumber, l_partkey, l_suppkey)) AS artifact FROM lineitem GROUP BY ALL)
SELECT context, artifact, n, n_artifacts > 1 AS conflict FROM a""")
def artifact_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terminal artifact of each run context, and whether a later one differed."""
    r = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("context"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_linestatus").alias("content_hash"))
    bound = B.bind(r, ["context"], ["l_linenumber", "l_partkey", "l_suppkey"])
    return bound.groupBy("context").agg(F.max("bound").alias("artifact"), F.count(F.lit(1)).alias("n"), (F.count_if(F.col("outcome") == "conflict") > 0).alias("conflict"))


@query("""WITH f AS (SELECT l_orderkey AS step, l_returnflag || '-' || l_linestatus AS code FROM lineitem)
SELECT step, CASE WHEN count(DISTINCT code) = 1 THEN min(code) ELSE 'superseded' END AS code, CASE WHEN count(DISTINCT code) > 1 THEN string_agg(code, ',' ORDER BY code) END AS superseded FROM f GROUP BY step""")
def superseded_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failure that each step carries for those of its calls."""
    f = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("step"), F.concat_ws("-", "l_returnflag", "l_linestatus").alias("code"))
    return B.superseded(f, "step")


_RESERVED = "CASE WHEN p_partkey % 21 = 0 THEN 2 WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END"


@query(f"""SELECT 'draft:' || p_brand || ':' || p_partkey AS id, trim(trim('" ' || p_name || ' "', '"'), ' ') AS template, 'draft:' || p_brand || ':' || p_partkey || repeat(':generated', {_RESERVED}) AS candidate_id FROM part""")
def draft_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts without quotes and white space around them, under ids that no earlier candidate has."""
    p = read(spark, sf_dir, "part")
    id_ = F.concat(F.lit("draft:"), "p_brand", F.lit(":"), F.col("p_partkey").cast("string"))
    reserved = p.filter("p_partkey % 7 = 0").select(F.explode(F.array(id_, F.when(F.col("p_partkey") % 21 == 0, F.concat(id_, F.lit(":generated"))), F.concat(id_, F.lit(":generated:generated:generated")))).alias("id")).filter("id IS NOT NULL")
    drafts = p.select(id_.alias("id"), F.trim(F.trim(F.concat(F.lit('" '), "p_name", F.lit(' "')), F.lit('"'))).alias("template"))
    return B.free_candidate_ids(drafts, staged(reserved, "reserved"))
