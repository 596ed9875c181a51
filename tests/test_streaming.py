from __future__ import annotations

from datetime import datetime, timedelta

from evalfold.operators import logs
from evalfold.streaming import operators as S


def run(spark, tmp_path, batches, schema, transform, name, mode="append"):
    """All rows that a stream over one file a batch puts out."""
    source = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source / f"b{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source / "*"))
    query = transform(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_admission_equals_batch(spark, tmp_path):
    rows = [("s" if i % 3 else "t", i, i) for i in range(30)]
    got = run(spark, tmp_path, [rows[:11], rows[11:], rows[5:8]], "scope string, call_id long, arrival long", lambda s: S.admission(s, 6), "admission")
    firsts = {(r.scope, r.call_id): (r.accepted, r.capacity_ordinal) for r in got.collect()}
    ledger = spark.createDataFrame([(s, c, sum(x[0] == s and x[1] <= c for x in rows)) for s, c, _ in rows], "scope string, call_id long, arrival long")
    want = {(r.scope, r.call_id): (r.accepted, r.capacity_ordinal) for r in logs.admitted(ledger, 6).collect()}
    assert firsts == want and got.count() == 33


def test_leases(spark, tmp_path):
    rows = [[(1, 0.0, "a", False), (1, 1.0, "b", False)], [(1, 4.0, "a", False), (1, 20.0, "b", False)], [(1, 21.0, "a", False), (1, 22.0, "b", True), (1, 23.0, "a", False), (2, 0.0, "z", False)]]
    got = run(spark, tmp_path, rows, "intent long, at double, owner string, done boolean", lambda s: S.leases(s, 5.0), "leases")
    one = [(r.outcome, r.generation) for r in got.filter("intent = 1").orderBy("at").collect()]
    assert one == [("acquired", 0), ("busy", 0), ("renewed", 0), ("acquired", 1), ("busy", 1), ("renewed", 1), ("succeeded", 1)]


def test_effect_leases_expire_by_themselves(spark, tmp_path):
    t = datetime(2024, 1, 1)
    at = lambda s: t + timedelta(seconds=s)
    rows = [
        [(1, at(0), "a", "r", "ask"), (1, at(1), "b", "r", "ask"), (1, at(2), "a", "r", "ask"), (1, at(3), "b", "other", "ask"), (2, at(0), "a", "q", "ask"), (2, at(1), "b", "q", "succeed"), (2, at(2), "a", "q", "succeed"), (2, at(3), "b", "q", "ask")],
        [(9, at(60), "z", "s", "ask")],  # the watermark moves beyond the end of the lease of 1
        [(9, at(62), "z", "s", "ask")],
        [(1, at(63), "b", "r", "ask"), (1, at(64), "a", "r", "fail"), (1, at(65), "b", "r", "fail"), (1, at(66), "a", "r", "ask")],
    ]
    schema = "intent long, at timestamp, owner string, request string, op string"
    got = run(spark, tmp_path, rows, schema, lambda s: S.effect_leases(s, 10.0, True), "effects").filter("intent < 9").collect()
    one = [(r.outcome, r.generation) for r in sorted((r for r in got if r.intent == 1), key=lambda r: r.at)]
    assert one == [("acquired", 0), ("busy", 0), ("renewed", 0), ("request-conflict", 0), ("expired", 0), ("acquired", 1), ("fenced", 1), ("failed", 1), ("failed", 1)]
    assert [r.outcome for r in sorted((r for r in got if r.intent == 2), key=lambda r: r.at)] == ["acquired", "fenced", "succeeded", "succeeded"]
    kept = run(spark, tmp_path / "no", rows, schema, lambda s: S.effect_leases(s, 10.0, False), "kept").filter("intent = 1 AND outcome = 'recovery-required'")
    assert kept.count() == 2


def test_deferred_intents_are_buffered(spark, tmp_path):
    batches = [[("s", 1, "persist", ["a", "b"]), ("s", 2, "load", [])], [("s", 3, "load", []), ("s", 4, "evict", []), ("t", 1, "load", [])], [("s", 5, "load", []), ("s", 6, "persist", ["c"]), ("s", 7, "load", [])]]
    got = run(spark, tmp_path, batches, "step string, at long, op string, intents array<string>", S.deferred_buffer, "buffer").collect()
    assert {(r.step, r.at): r.intents for r in got} == {("s", 2): ["a", "b"], ("s", 3): ["a", "b"], ("t", 1): [], ("s", 5): [], ("s", 7): ["c"]}


def test_fan_in_equals_batch_and_drops_late_rows(spark, tmp_path):
    schema = "intent long, invalid boolean, failed boolean"
    first = [(1, False, False), (2, False, True), (3, False, False), (2, False, False)]
    second = [(1, False, False), (3, True, True), (4, False, False), (2, True, True)]
    got = run(spark, tmp_path, [first, second], schema, lambda s: S.fan_in(s, 2), "fan_in")
    assert {(r.intent, r.resolution, r.n_rows) for r in got.collect()} == {(1, "complete", 2), (2, "failed", 2), (3, "rejected", 2)}


def test_windows_with_late_data(spark, tmp_path):
    schema = "candidate_id string, at timestamp, scored boolean"
    t = datetime(2024, 1, 1)
    batches = [[("c", t + timedelta(minutes=m), m % 2 == 0) for m in (1, 2, 3)], [("c", t + timedelta(minutes=45), True)], [("c", t + timedelta(minutes=46), True)], [("c", t + timedelta(minutes=2), True), ("c", t + timedelta(minutes=90), True)]]
    got = run(spark, tmp_path, batches, schema, lambda s: S.scored_rates(s, "10 minutes", "5 minutes"), "rates")
    assert [(r.n, round(r.rate, 3)) for r in got.filter("start = timestamp '2024-01-01 00:00:00'").collect()] == [(3, 0.333)]


def test_upserted_log_holds_the_latest(spark, tmp_path):
    source, log = tmp_path / "in", str(tmp_path / "log")
    for i, rows in enumerate([[("k", 1, "a"), ("k", 2, "b"), ("l", 1, "c")], [("k", 5, "d")]]):
        spark.createDataFrame(rows, "key string, at long, value string").coalesce(1).write.parquet(str(source / f"b{i}"))
    stream = spark.readStream.schema("key string, at long, value string").option("maxFilesPerTrigger", 1).parquet(str(source / "*"))
    query = stream.writeStream.foreachBatch(S.upsert_log(log, ["key"], "at")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = S.read_log(spark.read.parquet(log), ["key"], "at")
    assert {(r.key, r.at, r.value) for r in got.collect()} == {("k", 5, "d"), ("l", 1, "c")}
