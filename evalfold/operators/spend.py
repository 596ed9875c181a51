"""What a run paid for: evidence refs of three channels, their output rows, and proposal calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalfold.operators.costs import classified, role_cost

# The schemas of evidence that is paid for.
EVIDENCE, FAILURE = "eval_evidence", "eval_failure"
REF = "struct<schema:string,content_hash:string>"


def failure_ref(details):
    """The failure evidence that a failed tool call's JSON details cite under `evidence_ref`; null where it isn't a ref of that schema."""
    ref = F.from_json(F.get_json_object(details, "$.evidence_ref"), REF, {"mode": "PERMISSIVE"})
    whole = ref["schema"].isNotNull() & ref["content_hash"].isNotNull() & (ref["schema"] == FAILURE)
    return F.when(whole, F.struct(ref["schema"].alias("schema"), ref["content_hash"].alias("content_hash")))


def evidence_refs(steps: DataFrame) -> DataFrame:
    """(run_id, schema, content_hash), once each, of steps (run_id, intent_refs, search_refs, tool_refs: arrays of refs; tool_details: JSON)."""
    channels = F.concat(*(F.coalesce(F.col(c), F.array().cast(f"array<{REF}>")) for c in ("intent_refs", "search_refs", "tool_refs")), F.array(failure_ref(F.col("tool_details"))))
    refs = steps.select("run_id", F.explode(channels).alias("r")).filter(F.col("r").isNotNull())
    return refs.select("run_id", "r.schema", "r.content_hash").filter(F.col("schema").isin(EVIDENCE, FAILURE)).distinct()


def answered(provider_error):
    """Whether a failed row's JSON error holds an answer of the provider that was rejected afterwards."""
    return F.coalesce(F.get_json_object(provider_error, "$.rejected_response").isNotNull(), F.lit(False))


def run_cost(steps: DataFrame, evidence: DataFrame, records: DataFrame, proposer: DataFrame) -> DataFrame:
    """Spend of each run by role (task_model, proposer).

    evidence: schema, content_hash, outputs_hash (null: it left no rows); records: content_hash, outputs (array of rows with tokens,
    cost, flags and provider_error). A ref cited by several steps or channels is paid once; a ref without evidence or
    rows costs nothing. proposer: run_id, call_id, tokens, cost. A call_id counts once in a run; calls without one (null
    or empty) are each counted.
    """
    cited = evidence_refs(steps).join(evidence, ["schema", "content_hash"])
    rows = cited.join(records.withColumnRenamed("content_hash", "outputs_hash"), "outputs_hash").select("run_id", F.explode("outputs").alias("o")).select("run_id", "o.*")
    task = role_cost(classified(rows.withColumn("response_rejected", answered(F.col("provider_error")))), ["run_id"])
    named = proposer.filter(F.coalesce(F.length("call_id") > 0, F.lit(False)))
    bare = proposer.filter(~F.coalesce(F.length("call_id") > 0, F.lit(False)))
    calls = named.dropDuplicates(["run_id", "call_id"]).unionByName(bare)
    spent = role_cost(calls.withColumn("use", F.lit("billable")), ["run_id"])
    return task.select(F.lit("task_model").alias("role"), "*").unionByName(spent.select(F.lit("proposer").alias("role"), "*"))
