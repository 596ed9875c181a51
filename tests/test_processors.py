from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from evalfold.operators import logs
from evalfold.streaming import processors as P

CALLS = "scope string, call_id long, arrival long"


@pytest.fixture(autouse=True)
def store(spark):
    P.rocksdb_store(spark)
    yield
    for name in ("providerClass", "rocksdb.changelogCheckpointing.enabled"):
        spark.conf.unset(f"spark.sql.streaming.stateStore.{name}")


def add(spark, tmp_path, rows, schema):
    n = len([*(tmp_path / "in").glob("b*")]) if (tmp_path / "in").exists() else 0
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))


def run(spark, tmp_path, schema, transform):
    """All rows so far, of a query that starts again from its checkpoint."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = transform(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
    assert query.awaitTermination(180) and query.exception() is None
    return spark.read.parquet(str(tmp_path / "out"))


def test_admission_equals_batch_over_restarts(spark, tmp_path):
    rows = [("s" if i % 3 else "t", i, i) for i in range(30)]
    step = lambda s: P.admission(s, 6)
    add(spark, tmp_path, rows[:11], CALLS)
    run(spark, tmp_path, CALLS, step)
    add(spark, tmp_path, rows[11:], CALLS)
    add(spark, tmp_path, rows[5:8], CALLS)
    got = run(spark, tmp_path, CALLS, step)
    ledger = spark.createDataFrame([(s, c, sum(x[0] == s and x[1] <= c for x in rows)) for s, c, _ in rows], CALLS)
    want = {(r.scope, r.call_id): (r.accepted, r.capacity_ordinal) for r in logs.admitted(ledger, 6).collect()}
    assert got.count() == 33 and {(r.scope, r.call_id): (r.accepted, r.capacity_ordinal) for r in got.collect()} == want
    entries = P.stored_state(spark, str(tmp_path / "ck"), "ordinals").collect()
    held = {(r.key.scope, r.user_map_key.call_id): r.user_map_value.ordinal for r in entries}
    assert held == {k: v for k, (ok, v) in want.items() if ok} and len(held) == 12
    assert P.stored_state(spark, str(tmp_path / "ck"), "ordinals", 0).count() < 12


def test_admission_starts_from_a_ledger(spark, tmp_path):
    ledger = spark.createDataFrame([("s", 7, 1), ("s", 8, 2)], "scope string, call_id long, capacity_ordinal long")
    add(spark, tmp_path, [("s", 1, 1), ("s", 7, 2), ("s", 2, 3), ("u", 7, 1)], CALLS)
    got = run(spark, tmp_path, CALLS, lambda s: P.admission(s, 3, ledger)).collect()
    assert {(r.scope, r.call_id): r.capacity_ordinal for r in got} == {("s", 1): 3, ("s", 7): 1, ("s", 2): None, ("u", 7): 1}


def test_barrier_counts_rows_once(spark, tmp_path):
    schema = "intent long, row_id long, invalid boolean, failed boolean"
    step = lambda s: P.barrier(s, 3)
    add(spark, tmp_path, [(1, 0, False, False), (1, 0, False, False), (2, 0, False, True), (2, 1, False, False), (3, 5, False, False)], schema)
    run(spark, tmp_path, schema, step)
    add(spark, tmp_path, [(1, 1, False, False), (1, 2, False, False), (2, 1, False, False), (2, 2, False, False), (3, 6, True, True), (3, 7, False, False), (4, 0, False, False)], schema)
    add(spark, tmp_path, [(1, 9, True, True), (4, 0, True, False)], schema)
    got = sorted(tuple(r) for r in run(spark, tmp_path, schema, step).collect())
    assert got == [(1, "complete", 3), (1, "late", 1), (1, "repeated", 1), (2, "failed", 3), (2, "repeated", 1), (3, "rejected", 3), (4, "repeated", 1)]
    assert {r.key.intent for r in P.stored_state(spark, str(tmp_path / "ck"), "rows").collect()} == {4}, "resolved intents hold no rows"


def test_claims_expire_by_timers(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    schema = "intent long, at timestamp, owner string, op string"
    batches = [
        [(1, at(0), "a", "ask"), (1, at(1), "b", "ask"), (1, at(4), "a", "ask"), (1, at(5), "b", "done"), (2, at(0), "a", "ask"), (2, at(2), "a", "done"), (2, at(3), "b", "ask")],
        [(9, at(60), "z", "ask")],
        [(9, at(62), "z", "ask")],
        [(1, at(63), "b", "ask"), (1, at(64), "a", "done"), (1, at(80), "c", "ask"), (1, at(81), "c", "done")],
    ]
    for rows in batches[:2]:
        add(spark, tmp_path, rows, schema)
    run(spark, tmp_path, schema, lambda s: P.claims(s, 10_000))
    for rows in batches[2:]:
        add(spark, tmp_path, rows, schema)
    got = run(spark, tmp_path, schema, lambda s: P.claims(s, 10_000)).filter("intent < 9").collect()
    one = [(r.at, r.outcome, r.generation) for r in sorted((r for r in got if r.intent == 1), key=lambda r: (r.at, r.generation))]
    assert one == [
        (at(0), "acquired", 0), (at(1), "busy", 0), (at(4), "renewed", 0), (at(5), "fenced", 0), (at(14), "expired", 0), (at(63), "acquired", 1), (at(64), "fenced", 1), (at(73), "expired", 1),
        (at(80), "acquired", 2), (at(81), "succeeded", 2),
    ]
    assert [r.outcome for r in sorted((r for r in got if r.intent == 2), key=lambda r: r.at)] == ["acquired", "succeeded", "succeeded"]
    ended = P.stored_state(spark, str(tmp_path / "ck"), "history").filter("key.intent = 1").collect()
    assert sorted((r.list_element.generation, r.list_element.ended) for r in ended) == [(0, "expired"), (1, "expired"), (2, "succeeded")]
