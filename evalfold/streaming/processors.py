"""Stateful operators whose state grows by entry: maps, lists and timers of the state store, not one value rewritten each batch.

They need the RocksDB store (`rocksdb_store`). Each gives what its counterpart in `evalfold.streaming.operators` or its batch form
gives; state can be seeded from a table when a query starts without a checkpoint, and read back with `stored_state`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rocksdb_store(spark: SparkSession) -> None:
    """Lets streaming queries that start from now on keep their state in RocksDB, with a log of changes for checkpoints."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


class _Admission(StatefulProcessor):
    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ordinals = handle.getMapState("ordinals", "call_id long", "ordinal long")
        self.used = handle.getValueState("used", "n long")

    def handleInitialState(self, key: tuple, initial: pd.DataFrame, timerValues) -> None:
        for r in initial.itertuples(index=False):
            self.ordinals.updateValue((int(r.call_id),), (int(r.capacity_ordinal),))
        top = int(initial["capacity_ordinal"].max())
        self.used.update((max(top, self.used.get()[0] if self.used.exists() else 0),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        used = self.used.get()[0] if self.used.exists() else 0
        before, out = used, []
        calls = pd.concat(rows).sort_values(["arrival", "call_id"], kind="stable")
        for call in calls["call_id"].tolist():
            ordinal = self.ordinals.getValue((call,))[0] if self.ordinals.containsKey((call,)) else None
            if ordinal is None and used < self.capacity:
                used = ordinal = used + 1
                self.ordinals.updateValue((call,), (ordinal,))
            out.append((key[0], call, ordinal is not None, ordinal))
        if used > before:
            self.used.update((used,))
        yield pd.DataFrame(out, columns=["scope", "call_id", "accepted", "capacity_ordinal"]).astype({"capacity_ordinal": "Int64"})


def admission(calls: DataFrame, capacity: int, accepted: DataFrame | None = None) -> DataFrame:
    """(scope, call_id, accepted, capacity_ordinal) of a stream of (scope, call_id, arrival); `accepted` (scope, call_id,
    capacity_ordinal) is what an earlier ledger let in.

    A call that was decided before gets its old decision again. Each accepted call is an entry of a map: a batch reads the entries of its
    own calls and adds those that it accepts.
    """
    initial = None if accepted is None else accepted.groupBy("scope")
    return calls.groupBy("scope").transformWithStateInPandas(
        _Admission(capacity), "scope string, call_id long, accepted boolean, capacity_ordinal long", "append", "none", initial
    )


class _Barrier(StatefulProcessor):
    def __init__(self, expected: int, keep_ms: int | None):
        self.expected, self.keep_ms = expected, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "row_id long", "invalid boolean, failed boolean", self.keep_ms)
        self.counts = handle.getValueState("counts", "n long, invalid boolean, failed boolean, resolved boolean", self.keep_ms)

    def handleInputRows(self, key: tuple, frames: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, invalid, failed, resolved = self.counts.get() if self.counts.exists() else (0, False, False, False)
        late, repeated = 0, 0
        for frame in frames:
            for r in frame.itertuples(index=False):
                if resolved:
                    late += 1
                elif self.rows.containsKey((int(r.row_id),)):
                    repeated += 1
                else:
                    self.rows.updateValue((int(r.row_id),), (bool(r.invalid), bool(r.failed)))
                    n, invalid, failed = n + 1, invalid or bool(r.invalid), failed or bool(r.failed)
                    if n == self.expected:
                        resolved = True
                        yield self._told(key, "rejected" if invalid else "failed" if failed else "complete", n)
                        self.rows.clear()
        self.counts.update((n, invalid, failed, resolved))
        for what, k in (("late", late), ("repeated", repeated)):
            if k:
                yield self._told(key, what, k)

    @staticmethod
    def _told(key: tuple, what: str, n: int) -> pd.DataFrame:
        return pd.DataFrame([(key[0], what, n)], columns=["intent", "resolution", "n_rows"])


def barrier(rows: DataFrame, expected: int, keep_ms: int | None = None) -> DataFrame:
    """(intent, resolution, n_rows) of a stream of (intent, row_id, invalid, failed): once for each intent whose `expected` distinct
    rows are in complete, failed or rejected, and for each batch the numbers of its late and repeated rows.

    A row that comes twice counts once. When an intent resolves, its rows leave the state; the fact that it did stays, or goes
    `keep_ms` after the intent's last row, as do the rows of an intent that never resolves.
    """
    return rows.groupBy("intent").transformWithStateInPandas(
        _Barrier(expected, keep_ms), "intent long, resolution string, n_rows long", "append", "none" if keep_ms is None else "processingTime"
    )


class _Claims(StatefulProcessor):
    def __init__(self, lease_ms: int):
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.claim = handle.getValueState("claim", "owner string, generation long, until long, done boolean")
        self.history = handle.getListState("history", "generation long, owner string, ended string")

    def _out(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["intent", "at", "owner", "outcome", "generation"])
        return out.astype({"at": "datetime64[us]"})

    def _rearm(self, until: int | None) -> None:
        for timer in [*self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        if until is not None:
            self.handle.registerTimer(until)

    def handleInputRows(self, key: tuple, frames: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        owner, generation, until, done = self.claim.get() if self.claim.exists() else ("", -1, 0, False)
        rows, out = pd.concat(frames).sort_values("at", kind="stable"), []
        for r in rows.itertuples(index=False):
            at = int(pd.Timestamp(r.at).timestamp() * 1000)
            live = generation >= 0 and at < until
            if done:
                outcome = "succeeded"
            elif r.op == "done":
                done = live and r.owner == owner
                outcome = "succeeded" if done else "fenced"
                if done:
                    self.history.appendValue((generation, owner, "succeeded"))
            elif live and r.owner != owner:
                outcome = "busy"
            elif live:
                outcome, until = "renewed", at + self.lease_ms
            else:
                if owner:  # its lease ran out before a timer told so
                    self.history.appendValue((generation, owner, "expired"))
                    out.append((key[0], pd.Timestamp(until, unit="ms"), owner, "expired", generation))
                outcome, owner, generation, until = "acquired", r.owner, generation + 1, at + self.lease_ms
            out.append((key[0], pd.Timestamp(r.at), r.owner, outcome, generation))
        self.claim.update((owner, generation, until, done))
        self._rearm(None if done or not owner else max(until, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._out(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        owner, generation, until, done = self.claim.get()
        if not done and owner and until <= expiredTimerInfo.getExpiryTimeInMs():
            self.history.appendValue((generation, owner, "expired"))
            self.claim.update(("", generation, until, False))
            yield self._out([(key[0], pd.Timestamp(until, unit="ms"), owner, "expired", generation)])


def claims(events: DataFrame, lease_ms: int, late: str = "0 seconds") -> DataFrame:
    """(intent, at, owner, outcome, generation) of a stream of (intent, at, owner, op: ask or done) in event time.

    ask: acquired, renewed (by the holder), busy (another holds it); done: succeeded, for good, or fenced if the owner's lease
    isn't live. A timer tells when a lease expires (once, with the end as `at`), when the watermark passes it or when a later
    request meets it first. How each generation ended is an entry of a list in the state.
    """
    return events.withWatermark("at", late).groupBy("intent").transformWithStateInPandas(
        _Claims(lease_ms), "intent long, at timestamp, owner string, outcome string, generation long", "append", "eventTime"
    )


def stored_state(spark: SparkSession, checkpoint: str, variable: str, batch: int | None = None) -> DataFrame:
    """What a query's state variable held after its last batch (or `batch`), read from its checkpoint: one row for an entry of a map,
    a value, or a list's item. A run that was lost is looked into by this before it starts again."""
    reader = spark.read.format("statestore").option("stateVarName", variable).option("flattenCollectionTypes", "true")
    return (reader if batch is None else reader.option("batchId", batch)).load(checkpoint)
