"""Queries that rank, select and compare: proposals, study history, Pareto fronts, pools and their members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalfold.operators import aggregates as A
from evalfold.operators import lineage as LI
from evalfold.operators import pareto as PF
from evalfold.operators import ranking as R
from evalfold.operators.logs import numbered
from evalfold.operators.scan import scanned
from evalfold.plans.registry import query
from evalfold.sources import records
from evalfold.sources.staging import staged
from evalfold.sources.tables import ctes, manifest, pass_rates, proposals, read, splits, study, trials


@query(ctes("proposals") + ", u AS (SELECT instruction, max(reward) AS reward, min(ordinal) AS first_ordinal FROM proposals GROUP BY instruction), w AS (SELECT instruction, reward, first_ordinal, (SELECT min(p.ordinal) FROM proposals p WHERE p.instruction = u.instruction AND p.reward = u.reward) AS ordinal FROM u) SELECT *, row_number() OVER (ORDER BY reward DESC, first_ordinal) AS rank FROM w")
def rank_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions by their best reward, ties by first occurrence."""
    return R.ranked(R.unique_best(proposals(spark, sf_dir), ["instruction"]), [F.col("reward").desc(), "first_ordinal"])


@query(ctes("proposals") + """, r AS (SELECT DISTINCT round_index FROM proposals),
b AS (SELECT round_index, count(*) AS n, max(reward) AS batch_max, round(avg(reward), 9) AS batch_mean, min(reward) AS batch_min, round(stddev_pop(reward), 9) AS batch_std FROM proposals GROUP BY round_index),
s AS (SELECT r.round_index, instruction, max(reward) AS reward, min(ordinal) AS o FROM r JOIN proposals p ON p.round_index <= r.round_index GROUP BY ALL),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY round_index ORDER BY reward DESC, o) <= 10)
SELECT * FROM b JOIN (SELECT round_index, count(*) AS n_best, max(reward) AS best_max, round(avg(reward), 9) AS best_mean, min(reward) AS best_min, round(stddev_pop(reward), 9) AS best_std FROM t GROUP BY round_index) USING (round_index)""")
def round_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards of every round and of the ten best instructions so far."""
    return R.round_stats(proposals(spark, sf_dir), 10, breadth=10)


_PROMOTE = ctes("study") + """, c AS (SELECT combination, round(avg(score) FILTER (WHERE NOT is_full), 9) AS mean, min(trial_number) AS first_trial, bool_or(is_full) AS promoted FROM study GROUP BY combination),
k AS (SELECT *, row_number() OVER (ORDER BY mean DESC, first_trial) AS rank FROM c WHERE mean IS NOT NULL)
SELECT *, rank = coalesce((SELECT min(rank) FROM k WHERE NOT promoted), (SELECT max(rank) FROM k)) AS is_next FROM k"""


@query(_PROMOTE)
def promotion_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combinations by mean minibatch score and which is promoted next."""
    return R.promotion(study(spark, sf_dir))


@query(ctes("study") + "SELECT combination, max(score) AS score, arg_min(trial_number, trial_number) FILTER (WHERE score = best) AS trial_number FROM (SELECT *, max(score) OVER (PARTITION BY combination) AS best FROM study WHERE is_full) GROUP BY combination")
def best_full_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each combination's best full evaluation; of equal scores the first."""
    best = F.max(F.struct("score", (-F.col("trial_number")).alias("t"))).alias("b")
    return study(spark, sf_dir).filter("is_full").groupBy("combination").agg(best).select("combination", F.col("b.score").alias("score"), (-F.col("b.t")).alias("trial_number"))


@query(ctes("study") + ", b AS (SELECT combination, is_full, count(*) AS n, round(avg(score), 9) AS mean, min(trial_number) AS f FROM study GROUP BY combination, is_full) SELECT combination, is_full, n, mean, row_number() OVER (PARTITION BY is_full ORDER BY mean DESC, f) AS rank FROM b")
def leaderboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaderboards of full and of minibatch evaluations."""
    by = study(spark, sf_dir).groupBy("combination", "is_full").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 9).alias("mean"), F.min("trial_number").alias("_first"))
    return numbered(by, ["is_full"], None, [F.col("mean").desc(), "_first"], "rank").drop("_first")


@query("SELECT n AS trial, (n + 1) % 6 = 0 OR n = 59 AS due, n // 6 AS full_so_far FROM range(0, 61) AS r(n)")
def promotion_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials after which a full evaluation is due: every sixth, and the last but one of the adjusted number."""
    n = F.col("trial")
    return spark.range(0, 61).withColumnRenamed("id", "trial").select("trial", (((n + 1) % 6 == 0) | (n == 59)).alias("due"), F.floor(n / 6).cast("long").alias("full_so_far"))


def _front(table: str, key: str | None, objectives: dict[str, str]) -> str:
    """SQL: the rows that no other row of their group beats, by comparing all of them."""
    worse = " AND ".join(f"b.{c} {'>=' if d == 'max' else '<='} a.{c}" for c, d in objectives.items())
    better = " OR ".join(f"b.{c} {'>' if d == 'max' else '<'} a.{c}" for c, d in objectives.items())
    return f"SELECT * FROM {table} a WHERE NOT EXISTS (SELECT 1 FROM {table} b WHERE {f'b.{key} = a.{key} AND ' if key else ''}{worse} AND ({better}))"


_PARTS = "WITH p AS (SELECT {} AS group_id, p_partkey AS id, p_size AS quality, p_retailprice AS price FROM part) "
_SIZE_AND_PRICE = {"quality": "max", "price": "min"}


def _parts(spark: SparkSession, sf_dir: str, group) -> DataFrame:
    return read(spark, sf_dir, "part").select(group.alias("group_id"), F.col("p_partkey").alias("id"), F.col("p_size").alias("quality"), F.col("p_retailprice").alias("price"))


@query(_PARTS.format("p_brand") + _front("p", "group_id", _SIZE_AND_PRICE))
def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each brand that no other beats in size and price."""
    return PF.pareto_front(_parts(spark, sf_dir, F.col("p_brand")), _SIZE_AND_PRICE, ["group_id"])


@query(_PARTS.format("'all'") + _front("p", None, _SIZE_AND_PRICE))
def pareto_front_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no other beats in size and price."""
    return PF.pareto_front(_parts(spark, sf_dir, F.lit("all")), _SIZE_AND_PRICE, [])


_FOUR = {"quantity": "max", "price": "min", "discount": "max", "tax": "min"}


@query("WITH l AS (SELECT l_linenumber AS line, l_orderkey AS id, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax FROM lineitem) " + _front("l", "line", _FOUR))
def pareto_front_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines of each line number that no other beats in quantity, price, discount and tax; objectives come as vectors."""
    kinds = [F.struct(F.lit(n).alias("name"), F.lit(d).alias("direction"), F.col(f"l_{'extendedprice' if n == 'price' else n}").cast("double").alias("value")) for n, d in _FOUR.items()]
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("id"), F.array(*kinds).alias("vector"))
    return PF.pareto_front(PF.objective_columns(rows, "vector", _FOUR).drop("vector"), _FOUR, ["line"])


@query(ctes("trials") + ", s AS (SELECT task_id, candidate_id, round(avg(score), 9) AS score FROM trials WHERE state = 'scored' GROUP BY ALL) SELECT task_id, candidate_id, score FROM s QUALIFY score = max(score) OVER (PARTITION BY task_id)")
def per_instance_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates that are best at each task, ties included."""
    s = trials(spark, sf_dir).filter("state = 'scored'").groupBy("task_id", "candidate_id").agg(F.round(F.avg("score"), 9).alias("score"))
    return s.withColumn("_best", F.max("score").over(Window.partitionBy("task_id"))).filter("score = _best").drop("_best")


@query(ctes("pass_rates") + "SELECT task_id, rate FROM pass_rates WHERE task_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) ORDER BY rate, task_id LIMIT 50")
def lowest_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty tasks of lowest historical pass rate that aren't excluded (a top-k report)."""
    excluded = read(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("task_id"))
    return pass_rates(spark, sf_dir).join(excluded, "task_id", "left_anti").orderBy("rate", "task_id").limit(50)


@query(ctes("manifest") + "SELECT pool_key, role, task_id, pos, CASE WHEN role <> 'test' THEN 'whole' WHEN pos < 20 THEN 'capped' ELSE 'over' END AS part FROM manifest")
def manifest_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pool members in order, and which test members an official split of twenty takes."""
    part = F.when(F.col("role") != "test", "whole").when(F.col("pos") < 20, "capped").otherwise("over")
    return manifest(spark, sf_dir).select("pool_key", "role", "task_id", "pos", part.alias("part"))


@query(ctes("manifest") + "SELECT pool_key, role, task_id FROM manifest WHERE task_id NOT IN (SELECT doc_id FROM labels)")
def manifest_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that have no item."""
    items = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("task_id"))
    return manifest(spark, sf_dir).select("pool_key", "role", "task_id").join(items, "task_id", "left_anti").select("pool_key", "role", "task_id")


@query(ctes("manifest") + "SELECT m.pool_key, m.task_id, m.pos, row_number() OVER (PARTITION BY m.pool_key ORDER BY m.role, m.pos) - 1 AS caller_pos, quality FROM manifest m JOIN labels l ON m.task_id = l.doc_id")
def subset_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled members of each pool in the caller's order."""
    joined = manifest(spark, sf_dir).join(read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "task_id"), "task_id")
    chunk = F.struct("role", F.floor(F.col("pos") / 10_000).alias("range"))
    return numbered(joined, ["pool_key"], chunk, ["role", "pos"], "caller_pos").select("pool_key", "task_id", "pos", (F.col("caller_pos") - 1).alias("caller_pos"), "quality")


@query(ctes("splits") + "SELECT l.role AS role_a, r.role AS role_b, l.task_hash, count(*) AS n_pairs FROM (SELECT role, task_hash, count(*) AS n FROM splits GROUP BY ALL) l JOIN (SELECT role, task_hash, count(*) AS n FROM splits GROUP BY ALL) r ON l.task_hash = r.task_hash AND l.role < r.role GROUP BY ALL")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that occur in two roles: roles and hash."""
    by = splits(spark, sf_dir).select("role", "task_hash").distinct()
    other = by.select(F.col("role").alias("role_b"), "task_hash")
    both = by.withColumnRenamed("role", "role_a").join(other, "task_hash").filter("role_a < role_b")
    return both.groupBy("role_a", "role_b", "task_hash").agg(F.count(F.lit(1)).alias("n_pairs"))


@query(ctes("splits") + "SELECT task_hash, count(DISTINCT role) AS n_roles, min(doc_id) AS first_doc FROM splits GROUP BY task_hash")
def split_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of all splits' identities."""
    return splits(spark, sf_dir).groupBy("task_hash").agg(F.count_distinct("role").alias("n_roles"), F.min("doc_id").alias("first_doc"))


@query("SELECT p_type AS item, min(p_partkey) AS first_pos, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS new_pos FROM part GROUP BY p_type")
def union_distinct_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct items in the order of their first occurrence."""
    by = read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("item")).agg(F.min("p_partkey").alias("first_pos"))
    return R.ranked(by, ["first_pos"], "new_pos").withColumn("new_pos", F.col("new_pos") - 1)


@query("""WITH c AS (SELECT event_type AS candidate_id, row_number() OVER (ORDER BY event_type) - 1 AS i FROM (SELECT DISTINCT event_type FROM events)), t AS (SELECT c_custkey AS task_id, row_number() OVER (ORDER BY c_custkey) - 1 AS t, count(*) OVER () AS n FROM customer)
SELECT candidate_id, task_id, k AS seed_index, (i * n + t) * 3 + k AS row_ordinal FROM c, t, range(0, 3) AS s(k)""")
def plan_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planned rows with one running ordinal over candidates, tasks and seeds, by arithmetic on dense numbers."""
    c = R.ranked(read(spark, sf_dir, "events").select(F.col("event_type").alias("candidate_id")).distinct(), ["candidate_id"], "i")
    tasks = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"))
    t = numbered(tasks, [], F.floor(F.col("task_id") / 10_000), ["task_id"], "t")
    plan = A.plan_expand(c, t, 3)
    return plan.select("candidate_id", "task_id", "seed_index", (((F.col("i") - 1) * F.lit(tasks.count()) + F.col("t") - 1) * 3 + F.col("seed_index")).alias("row_ordinal"))


@query("""WITH g AS (SELECT doc_id AS pos, CASE WHEN doc_id % 17 = 0 THEN 'x' || doc_id WHEN doc_id % 3 = 0 THEN md5(doc_id::VARCHAR) WHEN doc_id % 5 = 0 THEN '1' ELSE doc_id::VARCHAR END AS given FROM labels),
r AS (SELECT doc_id::VARCHAR AS id, md5(doc_id::VARCHAR) AS hash FROM documents), h AS (SELECT pos, given, coalesce(a.hash, b.hash) AS hash FROM g LEFT JOIN r a ON a.id = given LEFT JOIN r b ON b.hash = given)
SELECT pos, given, hash, CASE WHEN hash IS NULL THEN 'unknown' WHEN row_number() OVER (PARTITION BY hash ORDER BY pos) > 1 THEN 'repeated' END AS problem FROM h""")
def task_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that a caller names by id or by hash, in the caller's order, with their hashes; unknown and repeated ones are reported."""
    k = F.col("doc_id")
    given = F.when(k % 17 == 0, F.concat(F.lit("x"), k.cast("string"))).when(k % 3 == 0, F.md5(k.cast("string").cast("binary"))).when(k % 5 == 0, "1").otherwise(k.cast("string"))
    g = read(spark, sf_dir, "labels").select(k.alias("pos"), given.alias("given"))
    ids = read(spark, sf_dir, "documents").select(k.cast("string").alias("id"), F.md5(k.cast("string").cast("binary")).alias("hash"))
    names = ids.select(F.explode(F.array("id", "hash")).alias("given"), "hash")
    j = g.join(names, "given", "left")
    first = j.groupBy("hash").agg(F.min("pos").alias("first"))
    problem = F.when(F.col("hash").isNull(), "unknown").when(F.col("pos") > F.col("first"), "repeated")
    return j.join(first, "hash", "left").select("pos", "given", "hash", problem.alias("problem"))


@query(ctes("manifest") + """, m AS (SELECT pool_key, role, task_id FROM manifest UNION ALL SELECT pool_key, 'test', task_id FROM manifest WHERE task_id % 50 = 0 UNION ALL SELECT pool_key, role, task_id FROM manifest WHERE task_id % 70 = 0)
SELECT pool_key, task_id, count(*) AS n, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM m GROUP BY ALL HAVING count(*) > 1""")
def pool_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that occur twice in a pool, in one role or in two."""
    m = manifest(spark, sf_dir).select("pool_key", "role", "task_id")
    every = m.unionByName(m.filter("task_id % 50 = 0").withColumn("role", F.lit("test"))).unionByName(m.filter("task_id % 70 = 0"))
    return records.manifest_conflicts(every).select("pool_key", "task_id", "n", F.array_join("roles", ",").alias("roles"))


@query(ctes("splits") + """, t AS (SELECT DISTINCT task_hash FROM splits WHERE role = 'internal_eval'), v AS (SELECT DISTINCT task_hash FROM splits WHERE role = 'official' UNION SELECT md5('lost')), r AS (SELECT task_hash, min(doc_id) AS pos FROM splits GROUP BY task_hash)
SELECT task_hash, pos, CASE WHEN pos IS NULL THEN 'unknown' WHEN a AND b THEN 'both' WHEN a THEN 'train' WHEN b THEN 'val' ELSE 'uncovered' END AS part FROM (SELECT coalesce(r.task_hash, v.task_hash) AS task_hash, pos, t.task_hash IS NOT NULL AS a, v.task_hash IS NOT NULL AS b FROM r LEFT JOIN t USING (task_hash) FULL JOIN v ON v.task_hash = r.task_hash)""")
def registry_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry's tasks by the training and validation parts that claim them: train, val, both (an overlap), or uncovered; and what
    a part claims that the registry doesn't know."""
    s = splits(spark, sf_dir)
    lost = spark.range(1).select(F.md5(F.lit("lost").cast("binary")).alias("task_hash"))
    rows = s.select("task_hash", "doc_id", (F.col("role") == "internal_eval").alias("a"), (F.col("role") == "official").alias("b")).unionByName(lost.select("task_hash", F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("a"), F.lit(True).alias("b")))
    by = rows.groupBy("task_hash").agg(F.min("doc_id").alias("pos"), F.max("a").alias("a"), F.max("b").alias("b"))
    part = F.when(F.col("pos").isNull(), "unknown").when(F.col("a") & F.col("b"), "both").when(F.col("a"), "train").when(F.col("b"), "val").otherwise("uncovered")
    return by.select("task_hash", "pos", part.alias("part"))


_BEST = ctes("proposals") + ", u AS (SELECT instruction, max(reward) AS reward, min(ordinal) AS f FROM proposals GROUP BY instruction), k AS (SELECT instruction, reward, row_number() OVER (ORDER BY reward DESC, f) AS rank FROM u)"


@query(_BEST + " SELECT instruction, reward, row_number() OVER (ORDER BY rank DESC) AS shown FROM k WHERE rank <= 8")
def prompt_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best instructions as a proposal sees them: worst first (a top-k report)."""
    top = R.ranked(R.unique_best(proposals(spark, sf_dir), ["instruction"]), [F.col("reward").desc(), "first_ordinal"]).filter("rank <= 8")
    return R.ranked(top.withColumn("all", F.lit(1)), [F.col("rank").desc()], "shown", ["all"]).select("instruction", "reward", "shown")


@query(_BEST + ", w AS (SELECT b.n, least(b.n, (SELECT count(*) FROM k)) AS found FROM (VALUES (5), (500000000)) AS b(n)) SELECT w.n::BIGINT AS wanted, found AS found, CASE WHEN found < n THEN 'too few candidates' END AS problem, CASE WHEN found = n THEN (SELECT min(reward) FROM k WHERE rank <= 5) END AS least_reward FROM w")
def terminal_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best so many candidates that a run ends with; where there are too few, a failure instead."""
    k = R.ranked(R.unique_best(proposals(spark, sf_dir), ["instruction"]), [F.col("reward").desc(), "first_ordinal"]).select("rank", "reward")
    wanted = spark.createDataFrame([(5,), (500_000_000,)], "wanted long")
    by = k.join(F.broadcast(wanted), F.col("rank") <= F.col("wanted")).groupBy("wanted").agg(F.count(F.lit(1)).alias("found"), F.min("reward").alias("least"))
    few = F.col("found") < F.col("wanted")
    return by.select("wanted", "found", F.when(few, "too few candidates").alias("problem"), F.when(~few, F.col("least")).alias("least_reward"))


_OBJECTIVES = {"quantity": "max", "price": "min", "discount": "max"}
_LINEAGE = """ro AS (SELECT l_partkey AS candidate, l_suppkey AS task, l_quantity::BIGINT AS quantity, round(l_extendedprice * 100)::BIGINT AS price, round(l_discount * 100)::BIGINT AS discount FROM lineitem),
ev AS (SELECT candidate, task, sum(quantity)::DOUBLE / count(*) AS score FROM ro GROUP BY ALL),
ca AS (SELECT candidate, sum(quantity)::DOUBLE / count(*) AS quantity, sum(price)::DOUBLE / count(*) AS price, sum(discount)::DOUBLE / count(*) AS discount, count(*) AS n FROM ro GROUP BY candidate),
ed AS (SELECT p_partkey AS item, unnest(CASE WHEN p_size % 7 = 0 THEN [p_partkey // 3, p_partkey // 5] ELSE [p_partkey // 3] END) AS parent FROM part WHERE p_partkey > 0),
an AS (WITH RECURSIVE w AS (SELECT item, parent AS ancestor, 1::BIGINT AS distance FROM ed UNION SELECT w.item, ed.parent, w.distance + 1 FROM w JOIN ed ON w.ancestor = ed.item) SELECT item, ancestor, max(distance) AS distance FROM w GROUP BY ALL),
li AS (SELECT item AS candidate, count(*) AS n_ancestors, max(distance) AS depth FROM an GROUP BY item)"""
_COVER = """me AS (SELECT task AS s, candidate, ca.quantity AS score FROM (SELECT * FROM ev QUALIFY score = max(score) OVER (PARTITION BY task)) JOIN ca USING (candidate)),
la AS (SELECT s, last(candidate ORDER BY score, candidate) AS c FROM me GROUP BY s),
od AS (SELECT c, row_number() OVER (ORDER BY score, c) AS i FROM (SELECT DISTINCT c, score FROM la JOIN me ON me.s = la.s AND me.candidate = la.c)),
st AS (SELECT od.i, od.c, list((SELECT list(me.candidate) FROM me WHERE me.s = la.s AND me.candidate <> la.c)) AS others FROM od JOIN la USING (c) GROUP BY ALL),
ke AS (WITH RECURSIVE g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL
  SELECT st.i, CASE WHEN len(list_filter(st.others, lambda o: NOT list_has_any(coalesce(o, []), g.kept))) > 0 THEN list_append(g.kept, st.c) ELSE g.kept END FROM g JOIN st ON st.i = g.i + 1)
  SELECT unnest(kept) AS candidate FROM (SELECT kept FROM g ORDER BY i DESC LIMIT 1))"""


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, parent): a search in which a candidate comes from one, or from two that were merged."""
    p = read(spark, sf_dir, "part").filter("p_partkey > 0")
    parents = F.when(F.col("p_size") % 7 == 0, F.expr("array(p_partkey div 3, p_partkey div 5)")).otherwise(F.expr("array(p_partkey div 3)"))
    return p.select(F.col("p_partkey").alias("item"), F.explode(parents).alias("parent"))


@query("WITH " + _LINEAGE + "SELECT * FROM an")
def search_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors of each candidate of the search, at the longest distance."""
    return LI.ancestors(lineage(spark, sf_dir))


@query("WITH " + _LINEAGE + ", " + _COVER + """, fr AS (SELECT candidate FROM ca a WHERE NOT EXISTS (SELECT 1 FROM ca b WHERE b.quantity >= a.quantity AND b.price <= a.price AND b.discount >= a.discount AND (b.quantity > a.quantity OR b.price < a.price OR b.discount > a.discount)))
SELECT candidate, quantity, price, discount, coalesce(n_ancestors, 0) AS n_ancestors, coalesce(depth, 0) AS depth, (sum(n) OVER (ORDER BY candidate))::BIGINT AS discovered_at, coalesce(b.n_best, 0) AS n_best,
 quantity = max(quantity) OVER () AS best_quantity, price = min(price) OVER () AS best_price, discount = max(discount) OVER () AS best_discount, candidate IN (SELECT candidate FROM fr) AS on_front, candidate IN (SELECT candidate FROM ke) AS kept
FROM ca LEFT JOIN li USING (candidate) LEFT JOIN (SELECT candidate, count(*) AS n_best FROM me GROUP BY candidate) b USING (candidate)""")
def search_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of a search: each candidate's mean objectives, lineage, evaluations until its discovery, the tasks and objectives that it
    is best at (ties included), whether it is on the objectives' front, and whether it stays when covered candidates go."""
    whole = {"quantity": F.col("l_quantity").cast("long"), "price": F.round(F.col("l_extendedprice") * 100).cast("long"), "discount": F.round(F.col("l_discount") * 100).cast("long")}
    sums = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("candidate"), F.col("l_suppkey").alias("task"))
    sums = staged(sums.agg(*(F.sum(x).alias(n) for n, x in whole.items()), F.count(F.lit(1)).alias("n")), "evaluations")
    evaluations = sums.select("candidate", "task", (F.col("quantity") / F.col("n")).alias("score"))
    by = sums.groupBy("candidate").agg(*((F.sum(n) / F.sum("n")).alias(n) for n in _OBJECTIVES), F.sum("n").alias("n"))
    by = staged(scanned(by, [], ["candidate"], sums={"discovered_at": F.col("n")}), "candidates")
    most = evaluations.groupBy("task").agg(F.max("score").alias("most"))
    best = staged(evaluations.join(most, "task").filter("score = most").select("task", "candidate"), "task-best")
    sets = best.join(by.select("candidate", "quantity"), "candidate").select(F.col("task").alias("set"), F.col("candidate").alias("item"), F.col("quantity").alias("score"))
    kept = LI.uncovered(sets).select(F.col("item").alias("candidate"), F.lit(True).alias("kept"))
    front = PF.pareto_front(by, _OBJECTIVES, []).select("candidate", F.lit(True).alias("on_front"))
    ends = by.agg(*((F.max(n) if d == "max" else F.min(n)).alias(f"end_{n}") for n, d in _OBJECTIVES.items()))
    lines = LI.ancestors(lineage(spark, sf_dir)).groupBy(F.col("item").alias("candidate")).agg(F.count(F.lit(1)).alias("n_ancestors"), F.max("distance").alias("depth"))
    out = by.crossJoin(F.broadcast(ends))  # one row
    for more in (lines, best.groupBy("candidate").agg(F.count(F.lit(1)).alias("n_best")), front, kept):
        out = out.join(more, "candidate", "left")
    known = lambda c, x: F.coalesce(c, F.lit(x)).alias(c)
    return out.select("candidate", *_OBJECTIVES, known("n_ancestors", 0), known("depth", 0), "discovered_at", known("n_best", 0), *((F.col(n) == F.col(f"end_{n}")).alias(f"best_{n}") for n in _OBJECTIVES), known("on_front", False), known("kept", False))
