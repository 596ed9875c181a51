"""Queries over documents, classes of failures, configurations, and the small rules of records and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalfold.functions import documents as D
from evalfold.functions.texts import escape_braces
from evalfold.plans.registry import query
from evalfold.sources.tables import attempts, ctes, read

# The evidence role of each split role; the classes of failures that are tried again; the keys of telemetry.
ROLES = {"internal_eval": "internal", "official": "official", "held_out": "held_out"}
RETRYABLE = ("transient", "rate_limited", "resource_exhaustion")
TELEMETRY = ("prompt_tokens", "completion_tokens", "total_tokens", "reasoning_tokens", "latency_s", "finish_reason", "provider_error", "provider_cost")

#: Pairs that one task compares.
_COMPARED = 50_000

_PAIRS = """x AS (SELECT event_id, event_id % 7 AS p, event_id % 3 AS q, event_type AS t, user_id::VARCHAR AS u, (event_id % 1000)::VARCHAR AS n FROM events),
y AS (SELECT *, '{"type":"' || t || '","user":' || u || ',"tags":[' || n || ',{"a":1,"b":null}]}' AS a, CASE p
  WHEN 0 THEN '{ "tags": [' || n || ', {"b": null, "a": 1}],' || chr(10) || '"user": ' || u || ', "type": "' || t || '" }'
  WHEN 1 THEN '{"type":"' || t || '","user":' || u || CASE q WHEN 0 THEN '.0' WHEN 1 THEN 'e0' ELSE '.00e0' END || ',"tags":[' || n || '.00,{"a":1.0,"b":null}]}'
  WHEN 2 THEN '{"type":"' || t || '","user":1' || u || ',"tags":[' || n || ',{"a":1,"b":null}]}'
  WHEN 3 THEN '{"type":"' || t || '","user":' || u || ',"tags":[{"a":1,"b":null},' || n || ']}'
  WHEN 4 THEN '{"type":"' || t || '","user":"' || u || '","tags":[' || n || ',{"a":1,"b":null}]}'
  WHEN 5 THEN CASE q WHEN 0 THEN '{"user": NaN}' WHEN 1 THEN '{"user": 01}' ELSE '["a", 1]' END
  ELSE '{"type":"' || t || '","user":' || u || CASE q WHEN 0 THEN '.5' ELSE 'e1' END || ',"tags":[' || n || ',{"a":1,"b":null}]}' END AS b FROM x)"""


def _leaves(json: str) -> str:
    """SQL: the paths of a document with what stands there, numbers as decimals."""
    return f"(SELECT list(fullkey || ' ' || CASE WHEN type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number ' || coalesce(TRY_CAST(atom AS DECIMAL(30, 6))::VARCHAR, 'none') WHEN type IN ('OBJECT', 'ARRAY') THEN type ELSE type || ' ' || coalesce(atom::VARCHAR, '') END ORDER BY fullkey) FROM json_tree(CASE WHEN json_valid({json}) THEN {json} ELSE '{{}}' END))"


@query("WITH " + _PAIRS + """, z AS (SELECT *, CASE WHEN NOT json_valid(b) OR list_contains((SELECT list(lower(atom::VARCHAR)) FROM json_tree(CASE WHEN json_valid(b) THEN b ELSE '{}' END) WHERE type = 'DOUBLE'), 'nan') THEN 'not JSON' WHEN json_type(b) <> 'OBJECT' THEN 'not an object' END AS problem FROM y)
""" + f"SELECT event_id, CASE WHEN problem IS NULL THEN {_leaves('a')} = {_leaves('b')} END AS equal, problem FROM z")
def canonical_json_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of JSON documents that are equal whatever the order of their keys and the spelling of their numbers, and what can't be a record."""
    p, q = F.col("event_id") % 7, F.col("event_id") % 3
    t, u, n = F.col("event_type"), F.col("user_id").cast("string"), (F.col("event_id") % 1000).cast("string")
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    document = lambda user, tags: text('{"type":"', t, '","user":', user, ',"tags":[', tags, "]}")
    pair = '{"a":1,"b":null}'
    left = document(u, text(n, ",", pair))
    spelt = text(u, F.when(q == 0, ".0").when(q == 1, "e0").otherwise(".00e0"))
    right = (
        F.when(p == 0, text('{ "tags": [', n, ', {"b": null, "a": 1}],\n"user": ', u, ', "type": "', t, '" }')).when(p == 1, document(spelt, text(n, '.00,{"a":1.0,"b":null}')))
        .when(p == 2, document(text("1", u), text(n, ",", pair))).when(p == 3, document(u, text(pair, ",", n))).when(p == 4, document(text('"', u, '"'), text(n, ",", pair)))
        .when(p == 5, F.when(q == 0, '{"user": NaN}').when(q == 1, '{"user": 01}').otherwise('["a", 1]')).otherwise(document(text(u, F.when(q == 0, ".5").otherwise("e1")), text(n, ",", pair)))
    )
    events = read(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    # Rows are few bytes and much work: the number of tasks is their count's, not that of bytes.
    events = events.repartition(max(8, -(-events.count() // _COMPARED)), "event_id")
    e = events.select("event_id", left.alias("a"), right.alias("b"))
    one = F.transform(F.array("b"), lambda b: F.struct(b.alias("b"), D.canonical(b).alias("c")))  # b's form is used several times
    problem = D.canonical_problem
    return e.select("event_id", "a", F.get(one, F.lit(0)).alias("x")).select("event_id", F.when(problem(F.col("x.b"), F.col("x.c")).isNull(), D.canonical(F.col("a")) == F.col("x.c")).alias("equal"), problem(F.col("x.b"), F.col("x.c")).alias("problem"))


@query(ctes("attempts") + """, c AS (SELECT logical_call_id, attempt_number, CASE outcome WHEN 'timeout' THEN 'transient' WHEN 'rate-limit' THEN 'rate_limited' WHEN 'rejected' THEN 'permanent' END AS class FROM attempts)
SELECT logical_call_id, count(*) AS n_links, arg_min(class, attempt_number) FILTER (WHERE class IS NOT NULL) AS class, coalesce(arg_min(class, attempt_number) FILTER (WHERE class IS NOT NULL) IN ('transient', 'rate_limited', 'resource_exhaustion'), false) AS retry FROM c GROUP BY logical_call_id""")
def exception_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each chain of causes: its first link that has one; and whether the step is tried again."""
    failure = F.when(F.col("outcome") == "timeout", "transient").when(F.col("outcome") == "rate-limit", "rate_limited").when(F.col("outcome") == "rejected", "permanent")
    chain = attempts(spark, sf_dir).select("logical_call_id", "attempt_number", failure.alias("class"))
    by = chain.groupBy("logical_call_id").agg(F.count(F.lit(1)).alias("n_links"), D.first_classified(F.col("attempt_number"), F.col("class")).alias("class"))
    return by.withColumn("retry", F.coalesce(F.col("class").isin(*RETRYABLE), F.lit(False)))


_VARIABLES = "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'default' END AS segment, (CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE 3 END)::VARCHAR AS repeats FROM customer"


@query(f"""WITH v AS ({_VARIABLES}), d AS (
SELECT id, 'aggregation' AS part, '{{"definition":"aggregation","variables":{{}}}}' AS text FROM v UNION ALL SELECT id, 'metric', '{{"definition":"metric","variables":{{"repeats":"' || repeats || '","segment":"' || segment || '"}}}}' FROM v
UNION ALL SELECT id, 'preprocessing', '{{"definition":"preprocessing","variables":{{"segment":"' || segment || '"}}}}' FROM v UNION ALL SELECT id, 'sampling', '{{"definition":"sampling","variables":{{"repeats":"' || repeats || '"}}}}' FROM v)
SELECT id, part, sha256(text) AS config_hash FROM d UNION ALL SELECT id, 'eval', sha256(string_agg(part || '=' || sha256(text), ';' ORDER BY part)) FROM d GROUP BY id""")
def materialized_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions with their variables resolved for each assignment: a hash of each part, and one of all parts."""
    c = read(spark, sf_dir, "customer")
    segment = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise("default")
    repeats = F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).otherwise(3).cast("string")
    v = c.select(F.col("c_custkey").alias("id"), segment.alias("segment"), repeats.alias("repeats"))
    text = lambda part, *names: F.concat(F.lit(f'{{"definition":"{part}","variables":'), F.to_json(F.struct(*sorted(names))) if names else F.lit("{}"), F.lit("}"))
    parts = {"aggregation": (), "metric": ("segment", "repeats"), "preprocessing": ("segment",), "sampling": ("repeats",)}
    hashes = {p: F.sha2(text(p, *names).cast("binary"), 256) for p, names in parts.items()}
    every = F.sha2(F.concat_ws(";", *(F.concat(F.lit(f"{p}="), h) for p, h in sorted(hashes.items()))).cast("binary"), 256)
    rows = F.array(*(F.struct(F.lit(p).alias("part"), h.alias("config_hash")) for p, h in (*hashes.items(), ("eval", every))))
    return v.select("id", F.inline(rows))


@query("""WITH s AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'practice' WHEN 1 THEN 'official' WHEN 2 THEN 'held_out' ELSE 'internal_eval' END AS split, CASE WHEN doc_id % 11 = 0 THEN 'official' WHEN doc_id % 7 = 1 THEN 'official' WHEN doc_id % 7 = 2 THEN 'held_out' ELSE 'internal' END AS claimed FROM documents),
r AS (SELECT *, CASE split WHEN 'internal_eval' THEN 'internal' WHEN 'official' THEN 'official' WHEN 'held_out' THEN 'held_out' END AS role FROM s)
SELECT doc_id, role, CASE WHEN role IS NULL THEN 'unknown split role' WHEN role <> claimed THEN 'other evidence role' END AS problem FROM r""")
def split_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence role of each split role, and claims that don't match it."""
    k = F.col("doc_id")
    split = F.when(k % 7 == 0, "practice").when(k % 7 == 1, "official").when(k % 7 == 2, "held_out").otherwise("internal_eval")
    claimed = F.when(k % 11 == 0, "official").when(k % 7 == 1, "official").when(k % 7 == 2, "held_out").otherwise("internal")
    role = F.create_map(*(F.lit(x) for p in ROLES.items() for x in p))[split]
    s = read(spark, sf_dir, "documents").select("doc_id", role.alias("role"), claimed.alias("claimed"))
    return s.select("doc_id", "role", F.when(F.col("role").isNull(), "unknown split role").when(F.col("role") != F.col("claimed"), "other evidence role").alias("problem"))


@query(ctes("attempts") + "SELECT logical_call_id, attempt_number, (prompt_tokens IS NOT NULL)::INT + (completion_tokens IS NOT NULL)::INT + (cost IS NOT NULL)::INT + 2 AS n_known, prompt_tokens, completion_tokens, round(greatest(0, ended_at - started_at), 9) AS latency_s, outcome AS finish_reason, cost AS provider_cost, logical_call_id % 2 = 0 AS cache_hit FROM attempts")
def metadata_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry and cache marks of each attempt, put into flat metadata and read back from it."""
    a = attempts(spark, sf_dir).withColumn("latency_s", F.round(F.greatest(F.lit(0.0), F.col("ended_at") - F.col("started_at")), 9))
    held = {"prompt_tokens": F.col("prompt_tokens"), "completion_tokens": F.col("completion_tokens"), "latency_s": F.col("latency_s"), "finish_reason": F.col("outcome"), "provider_cost": F.col("cost")}
    entries = F.array(*(F.struct(F.lit(k).alias("key"), held[k].cast("string").alias("value") if k in held else F.lit(None).cast("string").alias("value")) for k in TELEMETRY), F.struct(F.lit("cache_hit").alias("key"), (F.col("logical_call_id") % 2 == 0).cast("string").alias("value")))
    m = a.select("logical_call_id", "attempt_number", F.map_from_entries(entries).alias("m"))
    known = F.size(F.filter(F.array(*map(F.lit, TELEMETRY)), lambda k: F.col("m")[k].isNotNull()))
    return m.select(
        "logical_call_id", "attempt_number", known.alias("n_known"), *(F.col("m")[k].cast("long").alias(k) for k in ("prompt_tokens", "completion_tokens")), F.col("m")["latency_s"].cast("double").alias("latency_s"),
        F.col("m")["finish_reason"].alias("finish_reason"), F.col("m")["provider_cost"].cast("double").alias("provider_cost"), F.coalesce(F.col("m")["cache_hit"] == "true", F.lit(False)).alias("cache_hit"),
    )


# The sections of a rendered component.
SECTIONS = ("## Component 1: ", "### Metadata", "### Instruction", "### Demonstrations")


@query("""SELECT p_partkey AS id, concat_ws(chr(10), '## Component 1: ' || replace(replace(p_brand || '{x}', '{', '{{'), '}', '}}'), '### Metadata', '{{"component_id":"' || p_brand || '{{x}}","demo_index":' || (p_size % 3) || ',"instruction_index":' || (p_partkey % 5) || ',"ordinal":0}}', '### Instruction', 'Name {name} well.', '### Demonstrations',
CASE WHEN p_size % 3 = 0 THEN '[]' ELSE '[{{"name":"' || p_name || '","type":"' || p_type || '"}}]' END) AS rendered FROM part""")
def component_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components as prompt text: literal parts with doubled braces, the instruction with its placeholders as they are."""
    id_ = F.concat("p_brand", F.lit("{x}"))
    metadata = F.to_json(F.struct(id_.alias("component_id"), (F.col("p_size") % 3).alias("demo_index"), (F.col("p_partkey") % 5).alias("instruction_index"), F.lit(0).alias("ordinal")))
    demos = F.when(F.col("p_size") % 3 == 0, "[]").otherwise(escape_braces(F.to_json(F.array(F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("type"))))))
    head, meta, instruction, shown = map(F.lit, SECTIONS)
    text = F.concat_ws("\n", F.concat(head, escape_braces(id_)), meta, escape_braces(metadata), instruction, F.lit("Name {name} well."), shown, demos)
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("rendered"))


_NOTE = "coalesce(text, '') || CASE turn % 4 WHEN 0 THEN chr(233) || chr(128512) || chr(92) || chr(10) WHEN 1 THEN repeat('x', 1100) ELSE '' END"


@query(f"""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '  ' ELSE {_NOTE} END AS text FROM conversations),
b AS (SELECT *, CASE WHEN trim(text) = '' THEN '<unprintable message>' WHEN length(text) > 1024 THEN left(text, 1010) || '...[truncated]' ELSE text END AS bounded FROM t)
SELECT conv_id, turn, bounded, CASE WHEN bounded <> text THEN array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN c = chr(92) THEN chr(92) || chr(92) WHEN c = chr(10) THEN '\\n' WHEN c = chr(13) THEN '\\r' WHEN c = chr(9) THEN '\\t' WHEN unicode(c) BETWEEN 32 AND 126 THEN c
WHEN unicode(c) < 256 THEN printf('\\x%02x', unicode(c)) WHEN unicode(c) < 65536 THEN printf('\\u%04x', unicode(c)) ELSE printf('\\U%08x', unicode(c)) END), '') END AS original FROM b""")
def bounded_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure messages as a ledger takes them, and the escaped original where that differs (it must unescape to the message)."""
    t = F.col("turn") % 4
    more = F.when(t == 0, "é😀\\\n").when(t == 1, F.repeat(F.lit("x"), 1100)).otherwise("")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(t == 3, "  ").otherwise(F.concat(F.coalesce("text", F.lit("")), more)).alias("text"))
    rows = rows.withColumn("bounded", D.bounded(F.col("text"), "message")).withColumn("escaped", D.escaped(F.col("text")))
    back = F.when(D.unescaped(F.col("escaped")) == F.col("text"), F.col("escaped")).otherwise("lost")
    return rows.select("conv_id", "turn", "bounded", F.when(F.col("bounded") != F.col("text"), back).alias("original"))


@query("SELECT p_partkey AS id, ((p_partkey % 101) / (CASE p_partkey % 3 WHEN 0 THEN 100.0 WHEN 1 THEN 100000.0 ELSE 1000000000.0 END))::DOUBLE::VARCHAR AS token FROM part")
def tolerance_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tolerated shares as the text that identities are hashed from."""
    k = F.col("p_partkey")
    x = (k % 101) / F.when(k % 3 == 0, 100.0).when(k % 3 == 1, 100000.0).otherwise(1000000000.0)
    return read(spark, sf_dir, "part").select(k.alias("id"), D.float_token(x).alias("token"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS is_rejected, l_returnflag = 'N' AND l_linestatus = 'O' AS is_success FROM lineitem")
def result_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation results by type: rejected, success, or neither (failed)."""
    kind = F.when(F.col("l_returnflag") == "R", "rejected").when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), "success").otherwise("failure")
    rows = read(spark, sf_dir, "lineitem").withColumn("kind", kind)
    return rows.select("l_orderkey", "l_linenumber", (F.col("kind") == "rejected").alias("is_rejected"), (F.col("kind") == "success").alias("is_success"))


@query("""WITH p AS (SELECT p_type AS component, CASE length(p_type) % 3 WHEN 0 THEN 'fewshot' WHEN 1 THEN 'zeroshot' ELSE 'ground_only' END AS mode, count(*) AS n FROM part GROUP BY ALL)
SELECT component, mode, n AS n_grounding, CASE WHEN mode = 'fewshot' THEN n END AS n_study FROM p""")
def demo_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demo sets that ground proposals (in every mode) and that the study searches over (few-shot only)."""
    n = F.length("p_type") % 3
    mode = F.when(n == 0, "fewshot").when(n == 1, "zeroshot").otherwise("ground_only")
    by = read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("component"), mode.alias("mode")).agg(F.count(F.lit(1)).alias("n_grounding"))
    return by.withColumn("n_study", F.when(F.col("mode") == "fewshot", F.col("n_grounding")))
