"""Stateful operators over streams: admission up to a capacity, leases, barrier fan-in with late rows, and log upserts.

State is small for each key (a few numbers), never a buffer of rows. Each operator gives, over all batches together, what its
batch form in `evalfold.operators.logs` gives over the whole table, if rows of a key arrive in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evalfold.operators.logs import latest


def admission(calls: DataFrame, capacity: int) -> DataFrame:
    """(scope, call_id, accepted, capacity_ordinal) of a stream of (scope, call_id, arrival).

    A call that was decided before gets its old decision again and uses no capacity; remembered are accepted calls only,
    at most `capacity` for each scope, so a refused call that comes again is refused again.
    """

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        accepted = dict(zip(*state.get)) if state.exists else {}
        out = []
        for frame in frames:
            for call in frame.sort_values("arrival")["call_id"].tolist():
                if call not in accepted and len(accepted) < capacity:
                    accepted[call] = len(accepted) + 1
                out.append((key[0], call, call in accepted, accepted.get(call)))
        state.update(([*accepted], [*accepted.values()]))
        yield pd.DataFrame(out, columns=["scope", "call_id", "accepted", "capacity_ordinal"]).astype({"capacity_ordinal": "Int64"})

    return calls.groupBy("scope").applyInPandasWithState(
        decide, "scope string, call_id long, accepted boolean, capacity_ordinal long", "calls array<long>, ordinals array<long>", "append", GroupStateTimeout.NoTimeout
    )


def leases(events: DataFrame, lease: float) -> DataFrame:
    """(intent, at, owner, outcome, generation) of a stream of lease requests (intent, at, owner, done).

    acquired: no live lease, the generation grows; renewed: the holder asks again; busy: another holds it; succeeded: the
    effect is done, for good. A lease lasts `lease` seconds from its last renewal; a higher generation fences older owners.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        owner, generation, until, done = state.get if state.exists else ("", -1, float("-inf"), False)
        out = []
        for frame in frames:
            for row in frame.sort_values("at").itertuples(index=False):
                if done:
                    outcome = "succeeded"
                elif row.owner == owner and row.at < until:
                    outcome, until = "renewed", row.at + lease
                elif row.at < until:
                    outcome = "busy"
                else:
                    outcome, owner, generation, until = "acquired", row.owner, generation + 1, row.at + lease
                if row.done and row.owner == owner and outcome in ("acquired", "renewed"):
                    done = True
                out.append((key[0], row.at, row.owner, outcome, generation))
        state.update((owner, generation, until, done))
        yield pd.DataFrame(out, columns=["intent", "at", "owner", "outcome", "generation"])

    return events.groupBy("intent").applyInPandasWithState(
        step, "intent long, at double, owner string, outcome string, generation long", "owner string, generation long, until double, done boolean", "append", GroupStateTimeout.NoTimeout
    )


def effect_leases(events: DataFrame, lease: float, redrive: bool, late: str = "0 seconds") -> DataFrame:
    """(intent, at, owner, outcome, generation) of a stream of (intent, at, owner, request, op: ask, succeed or fail).

    ask: acquired (none holds it), renewed (the holder), busy (another), and after the lease ran out acquired again with the next generation
    where `redrive` allows it, else recovery-required. succeed and fail end the effect for good if the owner's lease is
    live, and are fenced otherwise; whoever asks later is told succeeded or failed. Another request than the effect's is a
    request-conflict and changes nothing. A lease that runs out is reported as expired when the watermark passes its end,
    without waiting for a next request.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        request, owner, generation, until, ended, told = state.get if state.exists else (None, "", -1, 0, "", False)
        out = []
        if state.hasTimedOut:
            out.append((key[0], pd.Timestamp(until, unit="us"), owner, "expired", generation))
            told = True
        for frame in frames:
            for r in frame.sort_values("at").itertuples(index=False):
                at = int(r.at.value // 1000)
                live = generation >= 0 and at < until
                if request is not None and r.request != request:
                    outcome = "request-conflict"
                elif ended:
                    outcome = ended
                elif r.op != "ask":
                    outcome = ended = ("succeeded" if r.op == "succeed" else "failed") if live and r.owner == owner else ""
                    outcome = outcome or "fenced"
                elif live and r.owner != owner:
                    outcome = "busy"
                elif not live and generation >= 0 and not redrive:
                    outcome = "recovery-required"
                else:
                    outcome = "renewed" if live else "acquired"
                    request, owner, generation, until, told = r.request, r.owner, generation + (not live), at + int(lease * 1e6), False
                out.append((key[0], r.at, r.owner, outcome, generation))
        state.update((request, owner, generation, until, ended, told))
        if generation >= 0 and not ended and not told:
            state.setTimeoutTimestamp(max(until // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["intent", "at", "owner", "outcome", "generation"])

    return events.withWatermark("at", late).groupBy("intent").applyInPandasWithState(
        step, "intent long, at timestamp, owner string, outcome string, generation long", "request string, owner string, generation long, until long, ended string, told boolean", "append", GroupStateTimeout.EventTimeTimeout
    )


def deferred_buffer(events: DataFrame) -> DataFrame:
    """(step, at, intents) at each load of a stream of (step, at, op: persist, load or evict, intents).

    A persist replaces what the step holds back, an eviction empties it; a step's intents are as many as one proposal makes.
    """

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [*state.get[0]] if state.exists else []
        out = []
        for frame in frames:
            for r in frame.sort_values("at").itertuples(index=False):
                if r.op == "load":
                    out.append((key[0], r.at, held))
                else:
                    held = [*r.intents] if r.op == "persist" else []
        if held:
            state.update((held,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["step", "at", "intents"])

    return events.groupBy("step").applyInPandasWithState(keep, "step string, at long, intents array<string>", "intents array<string>", "append", GroupStateTimeout.NoTimeout)


def fan_in(rows: DataFrame, expected: int) -> DataFrame:
    """(intent, resolution, n_rows) once for each intent, when its `expected` rows of (intent, invalid, failed) are in.

    Rows that arrive after the barrier resolved are late: they are dropped and change nothing.
    """

    def gather(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, invalid, failed = state.get if state.exists else (0, False, False)
        if n >= expected:
            return
        for frame in frames:
            own = frame.head(expected - n)
            n, invalid, failed = n + len(own), bool(invalid or own["invalid"].any()), bool(failed or own["failed"].any())
        state.update((n, invalid, failed))
        if n >= expected:
            resolution = "rejected" if invalid else "failed" if failed else "complete"
            yield pd.DataFrame([(key[0], resolution, n)], columns=["intent", "resolution", "n_rows"])

    return rows.groupBy("intent").applyInPandasWithState(gather, "intent long, resolution string, n_rows long", "n long, invalid boolean, failed boolean", "append", GroupStateTimeout.NoTimeout)


def scored_rates(events: DataFrame, window: str, late: str) -> DataFrame:
    """Scored share of each candidate in windows of event time (candidate_id, at, scored); rows later than `late` are dropped."""
    w = events.withWatermark("at", late).groupBy(F.window("at", window), "candidate_id")
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("scored").cast("double")).alias("rate")).select("window.start", "candidate_id", "n", "rate")


def upsert_log(path: str, keys: list[str], order: str):
    """A foreachBatch sink that appends to a log whose latest record of each key counts; `read_log` reads it.

    Every micro-batch writes a folder of its own, named by its number, so a batch that is run again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
        batch.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def read_log(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest record of each key of a log that `upsert_log` wrote."""
    return latest(log, keys, order, [c for c in log.columns if c not in (*keys, order, "batch")])
