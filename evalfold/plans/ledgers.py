"""Queries over ordered logs and durable hand-offs: claims, admission, budgets, fan-out and fan-in, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalfold.operators import claims as C
from evalfold.operators import logs
from evalfold.operators.aggregates import count_if
from evalfold.operators.scan import scanned
from evalfold.operators.statistics import hex_number
from evalfold.plans.registry import query
from evalfold.sources.staging import staged
from evalfold.sources.tables import claims, ctes, ledger, outputs, read, study, trials

#: Calls that a scope of the ledger accepts.
CAPACITY = 100


@query(ctes("claims") + "SELECT intent, owner, generation, heartbeat, event_ordinal FROM claims QUALIFY row_number() OVER (PARTITION BY intent ORDER BY event_ordinal DESC) = 1")
def claim_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claim that holds for each intent."""
    return logs.latest(claims(spark, sf_dir), ["intent"], "event_ordinal", ["owner", "generation", "heartbeat"])


@query(ctes("claims") + """, p AS (SELECT *, lag(owner) OVER w AS po, lag(generation) OVER w AS pg, lag(heartbeat) OVER w AS ph FROM claims WINDOW w AS (PARTITION BY intent ORDER BY event_ordinal))
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN po IS NULL THEN 'first' WHEN owner = po AND generation = pg AND heartbeat = ph + 1 THEN 'renewal' WHEN owner <> po AND generation = pg + 1 AND heartbeat = 0 THEN 'takeover' ELSE 'invalid' END AS kind FROM p) GROUP BY kind""")
def claim_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim events by kind: first, renewal, takeover, or invalid."""
    return C.transitions(claims(spark, sf_dir)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(ctes("claims") + "SELECT intent, arg_min(owner, event_ordinal) AS winner, min(event_ordinal) AS at, count(DISTINCT owner) AS n_results, count(DISTINCT owner) > 1 AS conflict FROM claims WHERE value >= 60 GROUP BY intent")
def claim_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each intent's first terminal event, and whether a later one differs."""
    ended = claims(spark, sf_dir).filter("value >= 60")
    return ended.groupBy("intent").agg(F.min_by("owner", "event_ordinal").alias("winner"), F.min("event_ordinal").alias("at"), F.count_distinct("owner").alias("n_results"), (F.count_distinct("owner") > 1).alias("conflict"))


@query(ctes("claims") + """, p AS (SELECT *, lag(owner) OVER w AS po, lag(value) OVER w AS pv FROM claims WINDOW w AS (PARTITION BY intent ORDER BY event_ordinal))
SELECT event_id, CASE WHEN po IS NULL THEN 'acquired' WHEN owner = po THEN 'renewed' WHEN pv >= 60 THEN 'succeeded' WHEN pv < 5 THEN 'recovery-required' ELSE 'busy' END AS outcome FROM p""")
def lease_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each event that asks for a lease is told, from the event before it."""
    return C.lease_outcomes(claims(spark, sf_dir), succeeded=60, expired=5).select("event_id", "outcome")


@query(ctes("ledger") + f"SELECT scope, call_id, arrival, CASE WHEN arrival <= {CAPACITY} THEN arrival END AS capacity_ordinal, arrival <= {CAPACITY} AS accepted FROM ledger")
def admission_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call's admission: accepted in order of arrival up to its scope's capacity."""
    return logs.admitted(ledger(spark, sf_dir), CAPACITY).select("scope", "call_id", "arrival", "capacity_ordinal", "accepted")


@query(ctes("ledger") + f"SELECT scope, count(*) FILTER (WHERE arrival <= {CAPACITY}) AS accepted, count(*) FILTER (WHERE arrival > {CAPACITY}) AS refused, round(sum(debit) FILTER (WHERE arrival <= {CAPACITY}), 2) AS debit FROM ledger GROUP BY scope")
def admitted_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and refused calls of each scope."""
    a = logs.admitted(ledger(spark, sf_dir), CAPACITY)
    return a.groupBy("scope").agg(count_if(F.col("accepted")).alias("accepted"), count_if(~F.col("accepted")).alias("refused"), F.round(F.sum(F.when(F.col("accepted"), F.col("debit"))), 2).alias("debit"))


@query(ctes("ledger") + "SELECT scope, call_id, round(sum(debit) OVER w, 2) AS consumed, round(50000000 - sum(debit) OVER w, 2) AS remaining, sum(debit) OVER w > 50000000 AS overdrawn FROM ledger WINDOW w AS (PARTITION BY scope ORDER BY arrival)")
def budget_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The budget left after each call of a scope."""
    rows = logs.numbered(ledger(spark, sf_dir), ["scope"], F.floor(F.col("arrival") / 10_000), ["arrival"], "total", "debit")
    total = F.col("total")
    return rows.select("scope", "call_id", F.round(total, 2).alias("consumed"), F.round(50_000_000 - total, 2).alias("remaining"), (total > 50_000_000).alias("overdrawn"))


@query(ctes("ledger") + "SELECT scope, count(*) AS n, min(arrival) AS first_slot, max(arrival) AS last_slot, count(DISTINCT call_id) AS n_calls, max(arrival) = count(*) AND count(DISTINCT call_id) = count(*) AS contiguous FROM ledger GROUP BY scope")
def ledger_slot_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each scope's slots are contiguous and claimed once."""
    n, calls, last = F.count(F.lit(1)), F.count_distinct("call_id"), F.max("arrival")
    return ledger(spark, sf_dir).groupBy("scope").agg(n.alias("n"), F.min("arrival").alias("first_slot"), last.alias("last_slot"), calls.alias("n_calls"), ((last == n) & (calls == n)).alias("contiguous"))


@query(ctes("ledger") + f""", r AS (SELECT DISTINCT l_orderkey AS call_id FROM lineitem WHERE l_returnflag = 'R'), a AS (SELECT * FROM ledger WHERE arrival <= {CAPACITY})
SELECT a.scope, count(*) AS accepted, count(r.call_id) AS reported, count(*) - count(r.call_id) AS unreported, (SELECT count(*) FROM r WHERE call_id NOT IN (SELECT call_id FROM a)) AS unknown FROM a LEFT JOIN r USING (call_id) GROUP BY a.scope""")
def ledger_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported calls against the durable ledger: accepted calls must all be reported, reported ones all be known."""
    reported = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("call_id")).distinct().withColumn("r", F.lit(1))
    a = logs.admitted(ledger(spark, sf_dir), CAPACITY).filter("accepted").select("scope", "call_id")
    unknown = reported.join(a, "call_id", "left_anti").agg(F.count(F.lit(1)).alias("unknown"))
    by = a.join(reported, "call_id", "left").groupBy("scope").agg(F.count(F.lit(1)).alias("accepted"), F.count("r").alias("reported"))
    return by.withColumn("unreported", F.col("accepted") - F.col("reported")).crossJoin(F.broadcast(unknown))


@query("""SELECT o_orderstatus AS state, o_orderpriority AS stage, o_orderkey AS execution_id, c_mktsegment AS run_id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus IN ('O', 'P')""")
def pending_stage_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executions that are pending, with their run."""
    o = read(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("O", "P"))
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("stage"), F.col("o_orderkey").alias("execution_id"), F.col("c_mktsegment").alias("run_id"))


@query(ctes("outputs") + "SELECT task_id AS intent, count(*) AS n_rows, min(event_id) AS first_event, count(DISTINCT candidate_id) AS n_candidates FROM outputs GROUP BY task_id")
def fanin_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row records by intent, with the first seen."""
    return outputs(spark, sf_dir).groupBy(F.col("task_id").alias("intent")).agg(F.count(F.lit(1)).alias("n_rows"), F.min("event_id").alias("first_event"), F.count_distinct("candidate_id").alias("n_candidates"))


@query(ctes("outputs") + "SELECT task_id AS intent, count(*) AS n_rows, (max(seed_index) + 1) * 5 AS expected, count(*) = (max(seed_index) + 1) * 5 AS complete FROM outputs GROUP BY task_id")
def fanin_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every row that an intent fanned out to has arrived."""
    expected = (F.max("seed_index") + 1) * 5
    return outputs(spark, sf_dir).groupBy(F.col("task_id").alias("intent")).agg(F.count(F.lit(1)).alias("n_rows"), expected.alias("expected"), (F.count(F.lit(1)) == expected).alias("complete"))


@query(ctes("outputs") + "SELECT task_id AS intent, candidate_id, CASE WHEN count(*) < 3 THEN 'waiting' WHEN bool_or(invalid) THEN 'rejected' WHEN bool_or(failed) THEN 'failed' ELSE 'complete' END AS resolution, count(*) AS n_rows FROM outputs GROUP BY ALL")
def fanin_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The barrier of each intent: waiting below three rows, then rejected before failed before complete."""
    return logs.fan_in(outputs(spark, sf_dir).withColumnRenamed("task_id", "intent"), ["intent", "candidate_id"], 3)


@query(ctes("claims") + """, h AS (SELECT intent, max(generation) AS head, arg_max(heartbeat, event_ordinal) AS last FROM claims GROUP BY intent),
j AS (SELECT event_id, generation AS step, head, CASE WHEN event_id % 4 <> 0 THEN heartbeat END AS episode, heartbeat AS resume, CASE WHEN intent % 3 = 0 THEN last END AS origin, last + 1 + (intent % 5 = 0)::INT AS watermark FROM claims JOIN h USING (intent))
SELECT event_id, CASE WHEN head > step THEN true WHEN head < step THEN false WHEN origin IS NOT NULL THEN coalesce(origin > episode, false) ELSE watermark > resume + 1 END AS stale FROM j""")
def late_fanin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fan-ins that the head of their intent has left behind, which must emit nothing.

    A later step of the head makes them stale; within a step, a head that is parked on a deferral is compared by where the
    episodes began, any other by whether its stage lies beyond what resuming this fan-in leads to.
    """
    c = claims(spark, sf_dir)
    head = c.groupBy("intent").agg(F.max("generation").alias("head"), F.max_by("heartbeat", "event_ordinal").alias("last"))
    j = c.join(head, "intent").select(
        "event_id", F.col("generation").alias("step"), "head", F.when(F.col("event_id") % 4 != 0, F.col("heartbeat")).alias("episode"), F.col("heartbeat").alias("resume"),
        F.when(F.col("intent") % 3 == 0, F.col("last")).alias("origin"), (F.col("last") + 1 + (F.col("intent") % 5 == 0).cast("int")).alias("watermark"),
    )
    stale = F.when(F.col("head") > F.col("step"), True).when(F.col("head") < F.col("step"), False).when(F.col("origin").isNotNull(), F.coalesce(F.col("origin") > F.col("episode"), F.lit(False))).otherwise(F.col("watermark") > F.col("resume") + 1)
    return j.select("event_id", stale.alias("stale"))


@query(ctes("claims") + "SELECT intent, max(generation) AS version, arg_max(event_id, event_ordinal) AS ref FROM claims GROUP BY intent")
def state_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last write of each head pointer."""
    return claims(spark, sf_dir).groupBy("intent").agg(F.max("generation").alias("version"), F.max_by("event_id", "event_ordinal").alias("ref"))


_DIGEST = "sum(('0x' || substr(md5(c_custkey::VARCHAR), 1, 8))::BIGINT)::BIGINT"


@query(f"""WITH m AS (SELECT c_nationkey AS run, count(*) AS n, {_DIGEST} AS digest FROM customer GROUP BY c_nationkey),
t AS (SELECT o_custkey AS member, max(o_orderkey) AS result FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey)
SELECT c_nationkey AS run, c_custkey AS member, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos, result,
CASE WHEN c_nationkey % 11 = 0 THEN 'other members than the manifest' WHEN c_nationkey % 7 = 0 THEN 'another number of members' WHEN result IS NULL THEN 'no terminal' END AS problem FROM customer JOIN m ON run = c_nationkey LEFT JOIN t ON member = c_custkey""")
def run_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each run in order with their terminals. A run whose members don't match its manifest's digest or count fails, and
    so does a member without a terminal. The digest is a sum of hashes, so it needs no order."""
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("run"), F.col("c_custkey").alias("member"))
    found = c.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum(hex_number(F.md5(F.col("member").cast("string").cast("binary")))).alias("digest"))
    # What the manifests claim: every seventh run's count and every eleventh run's digest is off.
    claimed = found.select("run", (F.col("n") + (F.col("run") % 7 == 0).cast("long")).alias("claimed_n"), (F.col("digest") + (F.col("run") % 11 == 0).cast("long")).alias("claimed"))
    terminals = read(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("member")).agg(F.max("o_orderkey").alias("result"))
    m = logs.numbered(c, ["run"], F.floor(F.col("member") / 10_000), ["member"], "pos").join(found, "run").join(claimed, "run").join(terminals, "member", "left")
    problem = F.when(F.col("digest") != F.col("claimed"), "other members than the manifest").when(F.col("n") != F.col("claimed_n"), "another number of members").when(F.col("result").isNull(), "no terminal")
    return m.select("run", "member", (F.col("pos") - 1).alias("pos"), "result", problem.alias("problem"))


@query("SELECT c_custkey AS row_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def pending_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a completed record: the ones that an idempotent worker still has to run."""
    done = read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("row_id"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id")).join(done, "row_id", "left_anti")


@query("""WITH s AS (SELECT l_orderkey * 8 + l_linenumber AS slot, md5(l_partkey::VARCHAR || '|' || l_suppkey::VARCHAR) AS request, l_extendedprice AS result, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS nth FROM lineitem)
SELECT slot, count(*) AS n_calls, count(*) - 1 AS replays, count(DISTINCT request) > 1 AS conflict, max(CASE WHEN nth = 1 THEN result END) AS result FROM s GROUP BY slot""")
def effect_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effect slots: the first result is replayed to later calls; another request for the same slot conflicts."""
    li = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("slot"), "l_partkey", "l_suppkey", "l_extendedprice")
    first = F.min(F.struct("l_partkey", "l_suppkey", "l_extendedprice"))
    return li.groupBy("slot").agg(
        F.count(F.lit(1)).alias("n_calls"), (F.count(F.lit(1)) - 1).alias("replays"), (F.count_distinct(F.struct("l_partkey", "l_suppkey")) > 1).alias("conflict"), first.alias("f"),
    ).select("slot", "n_calls", "replays", "conflict", F.col("f.l_extendedprice").alias("result"))


@query("SELECT l_orderkey AS run_id, l_linenumber AS step_index, count(DISTINCT l_partkey) AS n_requests FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_partkey) > 1")
def step_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that were asked for with different requests."""
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("step_index")).agg(F.count_distinct("l_partkey").alias("n_requests")).filter("n_requests > 1")


@query(ctes("trials") + "SELECT candidate_id, task_id, seed_index, coalesce(state, 'missing') AS state, row_number() OVER (PARTITION BY candidate_id ORDER BY task_id, seed_index) - 1 AS row_ordinal FROM trials")
def assemble_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row slices back in plan order: an ordinal by task and seed within each candidate."""
    rows = logs.numbered(trials(spark, sf_dir), ["candidate_id"], F.col("task_id"), ["task_id", "seed_index"], "row_ordinal")
    return rows.select("candidate_id", "task_id", "seed_index", "state", (F.col("row_ordinal") - 1).alias("row_ordinal"))


@query(ctes("study") + "SELECT trial_number, sum(CASE WHEN is_full THEN 4 ELSE 1 END) OVER (ORDER BY trial_number)::BIGINT + 4 AS calls_so_far FROM study")
def trial_running_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls spent by each trial: a baseline of four, four for a full evaluation, one for another."""
    rows = study(spark, sf_dir).select("trial_number", F.when(F.col("is_full"), 4).otherwise(1).cast("long").alias("calls"))
    return logs.running_total(rows, "trial_number", "calls").select("trial_number", (F.col("total") + 4).alias("calls_so_far"))


@query(ctes("ledger") + f""", t AS (SELECT l_orderkey AS call_id, arg_max(l_returnflag, l_linenumber * 1000 + ascii(l_returnflag)) AS outcome FROM lineitem GROUP BY ALL)
SELECT scope, arrival AS slot, call_id, outcome, arrival <= 5 AS replayed, CASE WHEN outcome IS NULL THEN CASE WHEN arrival <= 5 THEN 'replay not consumed' ELSE 'no terminal' END END AS problem FROM ledger LEFT JOIN t USING (call_id) WHERE arrival <= {CAPACITY}""")
def issued_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issued calls in order of slot with their terminals (of a call's lines the last); the first five of a scope are replayed and must be consumed."""
    issued = logs.admitted(ledger(spark, sf_dir), CAPACITY).filter("accepted")
    last = F.max_by("l_returnflag", F.col("l_linenumber") * 1000 + F.ascii("l_returnflag"))
    t = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("call_id")).agg(last.alias("outcome"))
    replayed = F.col("arrival") <= 5
    problem = F.when(F.col("outcome").isNull(), F.when(replayed, "replay not consumed").otherwise("no terminal"))
    return issued.join(t, "call_id", "left").select("scope", F.col("arrival").alias("slot"), "call_id", "outcome", replayed.alias("replayed"), problem.alias("problem"))


@query(ctes("ledger") + f"SELECT scope, CASE WHEN scope <> '1-URGENT' THEN count(*) FILTER (WHERE arrival <= {CAPACITY}) END AS tool_calls, round(sum(debit) FILTER (WHERE arrival <= {CAPACITY}), 2) AS debit FROM ledger GROUP BY scope")
def budget_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each step consumed: its debits, and as tool calls the number that the ledger issued, where its budget counts them."""
    a = logs.admitted(ledger(spark, sf_dir), CAPACITY)
    by = a.groupBy("scope").agg(count_if(F.col("accepted")).alias("n"), F.round(F.sum(F.when(F.col("accepted"), F.col("debit"))), 2).alias("debit"))
    return by.select("scope", F.when(F.col("scope") != "1-URGENT", F.col("n")).alias("tool_calls"), "debit")


@query("""WITH e AS (SELECT user_id AS run, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step, floor(value / 20)::BIGINT AS effect FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY run, effect ORDER BY step) = 1 AS paid FROM e),
c AS (SELECT *, sum(paid::INT) OVER (PARTITION BY run ORDER BY step)::BIGINT AS consumed FROM f)
SELECT run, step, effect, paid, consumed, consumed >= 4 AS terminal FROM c WHERE consumed - paid::INT < 4""")
def incremental_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of each run until its budget of four paid effects is used: an effect that an earlier step recorded is replayed."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "event_id", F.floor(F.col("value") / 20).alias("effect"))
    e = staged(scanned(e, ["run"], ["event_id"], number="step").withColumn("step", F.col("step") - 1), "steps")
    first = e.groupBy("run", "effect").agg(F.min("step").alias("first"))
    e = logs.join_null_safe(e, first, ["run", "effect"]).withColumn("paid", F.col("step") == F.col("first"))
    e = scanned(e, ["run"], ["step"], sums={"consumed": F.col("paid").cast("long")}, chunk=F.floor(F.col("step") / 10_000))
    return e.filter(F.col("consumed") - F.col("paid").cast("long") < 4).select("run", "step", "effect", "paid", "consumed", (F.col("consumed") >= 4).alias("terminal"))
