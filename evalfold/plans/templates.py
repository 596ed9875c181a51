"""Queries over templates, demos and proposals' texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalfold.functions import texts as T
from evalfold.plans.registry import query
from evalfold.sources.tables import ctes, read, traces

_TEMPLATE = """t AS (SELECT p_partkey AS id, p_name, p_brand, p_type, CASE p_partkey % 5 WHEN 0 THEN 'Say {name} of {brand}: {name}' WHEN 1 THEN 'Use {{literal}} and {name}' WHEN 2 THEN 'No field' WHEN 3 THEN 'Broken {name and {brand}' ELSE '{brand} {other}' END AS template FROM part),
b AS (SELECT *, replace(replace(template, '{{', ''), '}}', '') AS bare FROM t),
f AS (SELECT *, regexp_extract_all(bare, '\\{([A-Za-z_][A-Za-z0-9_]*)\\}', 1) AS fields, regexp_matches(regexp_replace(bare, '\\{[A-Za-z_][A-Za-z0-9_]*\\}', '', 'g'), '[{}]') AS malformed FROM b)"""


def _templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey") % 5
    text = F.when(p == 0, "Say {name} of {brand}: {name}").when(p == 1, "Use {{literal}} and {name}").when(p == 2, "No field").when(p == 3, "Broken {name and {brand}").otherwise("{brand} {other}")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_type", text.alias("template"))


@query("WITH " + _TEMPLATE + "SELECT id, array_to_string(fields, ',') AS fields, len(fields) AS n_fields, malformed FROM f")
def template_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The placeholders of every template, in order, and whether it is malformed."""
    fields = T.placeholders(F.col("template"))
    return _templates(spark, sf_dir).select("id", F.array_join(fields, ",").alias("fields"), F.size(fields).cast("long").alias("n_fields"), T.malformed(F.col("template")).alias("malformed"))


@query("WITH " + _TEMPLATE + "SELECT id, len(list_filter(fields, lambda x: x NOT IN ('name', 'brand'))) AS n_unknown, len(list_filter(fields, lambda x: x = 'name')) AS n_name, NOT malformed AND len(list_filter(fields, lambda x: x NOT IN ('name', 'brand'))) = 0 AND len(list_filter(fields, lambda x: x = 'name')) >= 1 AS valid FROM f")
def template_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates against a contract: only known fields, and the required one at least once."""
    t = _templates(spark, sf_dir).withColumn("fields", T.placeholders(F.col("template")))
    unknown = F.size(F.filter("fields", lambda x: ~x.isin("name", "brand"))).cast("long")
    name = F.size(F.filter("fields", lambda x: x == "name")).cast("long")
    return t.select("id", unknown.alias("n_unknown"), name.alias("n_name"), (~T.malformed(F.col("template")) & (unknown == 0) & (name >= 1)).alias("valid"))


@query("WITH " + _TEMPLATE + "SELECT id, replace(replace(replace(replace(replace(replace(template, '{{', chr(1)), '}}', chr(2)), '{name}', p_name), '{brand}', p_brand), chr(1), '{'), chr(2), '}') AS rendered FROM f")
def template_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every template rendered with its part's values."""
    return _templates(spark, sf_dir).select("id", T.render(F.col("template"), {"name": F.col("p_name"), "brand": F.col("p_brand")}).alias("rendered"))


@query("""WITH t AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '** Proposed Instruction: "' || p_name || '"' WHEN 1 THEN 'Note: Answer: ' || p_name ELSE p_name END AS text FROM part),
o AS (SELECT id, trim(regexp_replace(text, '^[\\*\\s]*(([A-Za-z0-9_]+ ){0,4}[A-Za-z0-9_]+):\\s*', ''), '"') AS text FROM t)
SELECT id, trim(regexp_replace(text, '^[\\*\\s]*(([A-Za-z0-9_]+ ){0,4}[A-Za-z0-9_]+):\\s*', ''), '"') AS text FROM o""")
def strip_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed instructions without labels and quotes."""
    p = F.col("p_partkey") % 3
    text = F.when(p == 0, F.concat(F.lit('** Proposed Instruction: "'), "p_name", F.lit('"'))).when(p == 1, F.concat(F.lit("Note: Answer: "), "p_name")).otherwise(F.col("p_name"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.strip_prefix(text).alias("text"))


@query("SELECT p_brand AS batch_of, p_size // 10 AS batch, string_agg(p_name, chr(10) || chr(10) ORDER BY p_partkey) AS text, count(*) AS n FROM part GROUP BY ALL")
def dataset_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples in batches, joined with blank lines in order."""
    by = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("batch_of"), F.floor(F.col("p_size") / 10).cast("int").alias("batch"))
    items = F.array_sort(F.collect_list(F.struct("p_partkey", "p_name")))
    return by.agg(F.array_join(F.transform(items, lambda x: x["p_name"]), "\n\n").alias("text"), F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey AS demo_id, concat_ws('; ', 'answer: ' || CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus ELSE o_orderpriority END, 'n: ' || CASE WHEN o_custkey % 3 = 0 THEN o_custkey ELSE o_orderkey END, CASE WHEN o_custkey % 5 = 0 THEN 'flags: {"late":' || (o_custkey % 2 = 0) || '}' END) AS demo FROM orders""")
def demo_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each demo's fields in declared order (answer, n, flags): inputs and outputs, where outputs win; what isn't a string is JSON."""
    c = F.col("o_custkey")
    entries = lambda *kv: F.map_from_entries(F.filter(F.array(*kv), lambda e: e.isNotNull()))
    pair = lambda key, value, holds: F.when(holds, F.struct(F.lit(key).alias("key"), value.alias("value")))
    inputs = entries(pair("answer", F.col("o_orderpriority"), F.lit(True)), pair("n", F.col("o_orderkey").cast("string"), F.lit(True)), pair("flags", F.to_json(F.struct((c % 2 == 0).alias("late"))), c % 5 == 0))
    outputs = entries(pair("answer", F.col("o_orderstatus"), c % 2 == 0), pair("n", c.cast("string"), c % 3 == 0))
    d = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("demo_id"), inputs.alias("i"), outputs.alias("o"))
    both = F.map_concat(F.map_filter("i", lambda k, _: ~F.array_contains(F.map_keys(F.col("o")), k)), F.col("o"))
    shown = F.filter(F.transform(F.array(*map(F.lit, ("answer", "n", "flags"))), lambda k: F.concat(k, F.lit(": "), both[k])), lambda x: x.isNotNull())
    return d.select("demo_id", F.array_join(shown, "; ").alias("demo"))


@query("""SELECT a.p_partkey AS id, a.p_brand IS DISTINCT FROM b.p_brand AS brand_changed, a.p_type IS DISTINCT FROM b.p_type AS type_changed, a.p_name <> '' AND a.p_name IS DISTINCT FROM b.p_name AND a.p_brand IS NOT DISTINCT FROM b.p_brand AND a.p_type IS NOT DISTINCT FROM b.p_type AS admissible
FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey - 1""")
def diff_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates against their base: admissible if only the mutated field differs, and isn't empty."""
    p = read(spark, sf_dir, "part")
    base = p.select((F.col("p_partkey") + 1).alias("id"), *(F.col(c).alias(f"b_{c}") for c in ("p_name", "p_brand", "p_type")))
    j = p.select(F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_type").join(base, "id", "left")
    same = lambda c: F.col(c).eqNullSafe(F.col(f"b_{c}"))
    return j.select("id", (~same("p_brand")).alias("brand_changed"), (~same("p_type")).alias("type_changed"), ((F.col("p_name") != "") & ~same("p_name") & same("p_brand") & same("p_type")).alias("admissible"))


@query("""WITH d AS (SELECT p_brand AS component, p_partkey AS id, p_name, p_partkey % 3 = 0 AS bootstrapped, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
r AS (SELECT component, k, id, p_name, row_number() OVER (PARTITION BY component, k ORDER BY ((pos - k) % n + n) % n) AS nth FROM d, range(1, 5) AS x(k) WHERE bootstrapped)
SELECT component, k AS proposal, string_agg(p_name, '; ' ORDER BY nth) AS demos FROM r WHERE nth <= 3 GROUP BY ALL""")
def rotated_demos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each proposal, the first three bootstrapped demos of its component after rotating them by the proposal's number."""
    w = Window.partitionBy("component")
    d = read(spark, sf_dir, "part").select(F.col("p_brand").alias("component"), F.col("p_partkey").alias("id"), "p_name")
    d = d.withColumn("pos", F.row_number().over(w.orderBy("id")) - 1).withColumn("n", F.count(F.lit(1)).over(w)).filter("id % 3 = 0")
    k = d.withColumn("proposal", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))))
    nth = F.row_number().over(Window.partitionBy("component", "proposal").orderBy(F.pmod(F.col("pos") - F.col("proposal"), F.col("n"))))
    top = k.withColumn("nth", nth).filter("nth <= 3")
    return top.groupBy("component", "proposal").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "p_name"))), lambda x: x["p_name"]), "; ").alias("demos"))


@query("SELECT l_orderkey AS run_id, count(*) AS n_rows, count(*) FILTER (WHERE l_linenumber > 3) AS n_failed, CASE WHEN bool_or(l_returnflag = 'R') THEN 'prediction failed: ' || count(*) FILTER (WHERE l_returnflag = 'R') || ' of ' || count(*) ELSE 'ok' END AS feedback FROM lineitem GROUP BY ALL")
def submission_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's feedback text about failed predictions."""
    failed = F.count_if(F.col("l_returnflag") == "R")
    text = F.when(failed > 0, F.concat(F.lit("prediction failed: "), failed.cast("string"), F.lit(" of "), F.count(F.lit(1)).cast("string"))).otherwise("ok")
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("l_linenumber") > 3).alias("n_failed"), text.alias("feedback"))
