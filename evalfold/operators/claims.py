"""Claim events of intents: owners, generations and heartbeats, and what each event is by the one before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalfold.operators.scan import scanned

#: Events of an intent that one task follows.
EVENTS = 10_000


def _chunk(number: str):
    return F.floor(F.col(number) / EVENTS)


def claim_events(events: DataFrame, intent: str, order: list[str], owner: str) -> DataFrame:
    """`events` with event_ordinal (from 1), generation (one more at each change of owner) and heartbeat (from 0 within it)."""
    r = scanned(events, [intent], order, number="event_ordinal", before={"_owner": owner})
    new = F.coalesce(F.col(owner) != F.col("_owner"), F.lit(False))
    first = F.when(new | (F.col("event_ordinal") == 1), F.col("event_ordinal"))
    r = scanned(r, [intent], ["event_ordinal"], sums={"generation": new.cast("long")}, most={"_first": first}, chunk=_chunk("event_ordinal"))
    return r.withColumn("heartbeat", F.col("event_ordinal") - F.col("_first")).drop("_owner", "_first")


def transitions(claims: DataFrame) -> DataFrame:
    """Claim events with `kind`: the first; a renewal (same owner and generation, next heartbeat); a takeover (next generation,
    heartbeat 0); anything else is invalid."""
    c = scanned(claims, ["intent"], ["event_ordinal"], before={f"_{x}": x for x in ("owner", "generation", "heartbeat")}, chunk=_chunk("event_ordinal"))
    same = (F.col("owner") == F.col("_owner")) & (F.col("generation") == F.col("_generation")) & (F.col("heartbeat") == F.col("_heartbeat") + 1)
    new = (F.col("owner") != F.col("_owner")) & (F.col("generation") == F.col("_generation") + 1) & (F.col("heartbeat") == 0)
    return c.withColumn("kind", F.when(F.col("_owner").isNull(), "first").when(same, "renewal").when(new, "takeover").otherwise("invalid"))


def lease_outcomes(claims: DataFrame, succeeded: float, expired: float) -> DataFrame:
    """Claim events with `outcome`, by the event before: none, the same owner, a success, an expired lease, or a live one."""
    c = scanned(claims, ["intent"], ["event_ordinal"], before={"_owner": "owner", "_value": "value"}, chunk=_chunk("event_ordinal"))
    out = F.when(F.col("_owner").isNull(), "acquired").when(F.col("owner") == F.col("_owner"), "renewed").when(F.col("_value") >= succeeded, "succeeded").when(F.col("_value") < expired, "recovery-required")
    return c.withColumn("outcome", out.otherwise("busy"))
