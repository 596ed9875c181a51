from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from evalfold.functions import documents as D
from evalfold.functions import texts as T
from evalfold.operators import aggregates as A
from evalfold.operators import chains, checks, costs, logs, ranking, sampling, spend
from evalfold.operators import statistics as S
from evalfold.sources import records


def status(spark, rows, reduction, propagate):
    df = spark.createDataFrame([(1, v, a) for v, a in rows], "k int, v double, a boolean")
    r = A.with_status(df, ["k"], "v", F.col("a"), reduction, propagate).first()
    return (r.status, r.value) if r else None


# Published expectations of the status rules.
@pytest.mark.parametrize("rows, reduction, propagate, want", [
    ([(None, False)], "mean", True, ("not_applicable", None)), ([(1.0, False)], "sum", False, ("not_applicable", None)), ([(None, True)], "mean", True, ("missing_data", None)),
    ([(None, True)], "mean", False, ("zero_denominator", None)), ([(None, True)], "sum", False, ("ok", 0.0)), ([(1.0, True), (None, True)], "mean", False, ("ok", 1.0)),
    ([(1.0, True), (None, True)], "mean", True, ("missing_data", None)), ([(1.0, True), (0.0, True), (5.0, False)], "mean", True, ("ok", 0.5)), ([(1.0, True), (2.0, True)], "sum", True, ("ok", 3.0)),
])
def test_statuses(spark, rows, reduction, propagate, want):
    assert status(spark, rows, reduction, propagate) == want


def test_invalid_is_not_missing(spark):
    rows = [("c", 1, 0, "scored", 1.0), ("c", 1, 1, "invalid", None), ("c", 2, 0, "scored", 0.0), ("c", 2, 1, "scored", 0.0), ("d", 1, 0, "missing", None), ("d", 1, 1, "scored", 1.0), ("e", 1, 0, "invalid", None)]
    df = spark.createDataFrame(rows, "candidate_id string, task_id long, seed_index long, state string, score double")
    got = {r.candidate_id: (r.value, r.status) for r in A.task_mean(df).collect()}
    assert got == {"c": (0.5, "ok"), "d": (None, "missing_data"), "e": (None, "not_applicable")}
    got = {r.candidate_id: (r.value, r.status) for r in A.task_mean(df, propagate=False, max_skip=0.3).collect()}
    assert got == {"c": (0.5, "ok"), "d": (None, "missing_data"), "e": (None, "missing_data")}


@pytest.mark.parametrize("policy, want", [("fail", None), ("worst_value", 0.75), ("skip", 1.0)])
def test_rewards_with_a_missing_term(spark, policy, want):
    values = spark.createDataFrame([("c", "m", 1.0), ("c", "n", math.nan)], "candidate_id string, metric string, value double")
    terms = spark.createDataFrame([("m", 1.0, 1), ("n", 0.5, -1)], "metric string, weight double, sign int")
    r = A.reward(values, terms, policy, worst=0.5).first()
    assert (r.reward, r.n_missing_terms) == (want, 1)


# Published expectations of Holm's procedure.
@pytest.mark.parametrize("p, want", [((0.02, 0.005, 0.04, 0.011), (0.04, 0.02, 0.04, 0.033)), ((0.01, 0.02, 0.021), (0.03, 0.04, 0.04))])
def test_holm(spark, p, want):
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(p)], "family string, id long, p double")
    got = {r.id: r.adjusted for r in S.holm(df, "p", "id", ["family"]).collect()}
    assert [round(got[i], 9) for i in range(len(p))] == list(want)


# Published expectations of detectable differences.
@pytest.mark.parametrize("interaction, repeats, tasks, want", [
    (0.05, 3, 220, 0.0879), (0.10, 3, 220, 0.0975), (0.15, 3, 220, 0.1063), (0.05, 5, 220, 0.0732), (0.05, 3, 440, 0.0622), (0.10, 3, 440, 0.0690), (0.05, 3, 132, 0.1135), (0.05, 3, 48, 0.1882),
])
def test_detectable_differences(spark, interaction, repeats, tasks, want):
    x = S.detectable(F.lit(tasks), F.lit(repeats), F.lit(0.25), F.lit(interaction), S.multiplier())
    assert abs(spark.range(1).select(x.alias("x")).first().x - want) < 5e-5


def test_multipliers():
    assert abs(S.multiplier() - 2.801585218112968) < 1e-12


def test_variance_split(spark):
    rates = [0.2, 0.4, 0.6, 0.8]
    df = spark.createDataFrame([("c", x, x) for x in rates], "k string, naive double, ceiling double")
    r = S.decompose_variance(df, ["k"], 4).first()
    assert (r.within, r.interaction) == (0.25, 0.0) and abs(r.between - (1 / 15 - 0.20 / 4)) < 1e-6


def test_unknown_cost_is_not_zero(spark):
    schema = "run string, prompt_tokens long, completion_tokens long, provider_cost double, cache_hit boolean, missing boolean, failed boolean, response_rejected boolean"
    rows = [("a", 1, 2, 0.5, False, False, False, False), ("a", 1, None, None, False, False, False, False), ("a", None, None, None, False, True, False, False), ("b", 3, 4, 1.0, False, False, False, False), ("b", 3, 4, 1.0, True, False, False, False), ("c", None, None, None, False, False, True, True)]
    got = {r.run: (r.calls, r.priced, r.cached, r.usd, r.prompt_tokens, r.missing_breakdown) for r in costs.role_cost(costs.classified(spark.createDataFrame(rows, schema)), ["run"]).collect()}
    assert got == {"a": (2, 1, 0, None, 1, 1), "b": (1, 1, 1, 1.0, 3, 0), "c": (1, 0, 0, None, None, 1)}


def test_promotion_falls_back_to_the_lowest(spark):
    rows = [(1, "x", 2.0, False), (2, "y", 1.0, False), (3, "x", 9.0, True), (4, "z", 2.0, False)]
    df = spark.createDataFrame(rows, "trial_number long, combination string, score double, is_full boolean")
    assert [r.combination for r in ranking.promotion(df).filter("is_next").collect()] == ["z"]
    every = df.unionByName(spark.createDataFrame([(5, "y", 1.0, True), (6, "z", 1.0, True)], df.schema))
    assert [r.combination for r in ranking.promotion(every).filter("is_next").collect()] == ["y"]


def test_ties_keep_the_first_instruction(spark):
    rows = [(0, 0, "b", 1.0), (1, 0, "a", 2.0), (2, 1, "b", 2.0), (3, 1, "c", 5.0)]
    df = spark.createDataFrame(rows, "ordinal long, round_index long, instruction string, reward double")
    got = ranking.ranked(ranking.unique_best(df, ["instruction"]), [F.col("reward").desc(), "first_ordinal"]).orderBy("rank").collect()
    assert [(r.instruction, r.ordinal) for r in got] == [("c", 3), ("b", 2), ("a", 1)]


def test_running_total_needs_no_single_task(spark):
    r = random.Random(3)
    rows = [(i, r.randrange(5)) for i in r.sample(range(100_000), 500)]
    got = {x.o: x.total for x in logs.running_total(spark.createDataFrame(rows, "o long, v long"), "o", "v", step=50).collect()}
    total, want = 0, {}
    for o, v in sorted(rows):
        total += v
        want[o] = total
    assert got == want


def test_checks_find_violations(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 2), ("b", 0), ("b", 1), ("c", 1), ("d", 0), ("d", 0), ("d", 2)], "k string, i long")
    assert {r.k for r in checks.not_contiguous(rows, ["k"], "i").collect()} == {"a", "c", "d"}


def test_templates(spark):
    df = spark.createDataFrame([("a {x} {{y}} {x}",), ("bad {x",), ("{x}}}",)], "t string")
    got = df.select(T.placeholders(F.col("t")).alias("p"), T.malformed(F.col("t")).alias("m"), T.render(F.col("t"), {"x": F.lit("{{1}")}).alias("r"), T.render(T.escape_braces(F.col("t")), {"x": F.lit("no")}).alias("e")).collect()
    assert got[0].p == ["x", "x"] and not got[0].m and got[1].m and got[0].r == "a {{1} {y} {{1}"
    assert [g.e for g in got] == ["a {x} {{y}} {x}", "bad {x", "{x}}}"]


def test_demo_plans_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([("c", i, i % 2 == 0) for i in range(20)], "component string, item long, bootstrapped boolean")
    one, two = (sorted(map(tuple, sampling.demo_plans(rows.repartition(n), 3, 4, 7).collect())) for n in (1, 5))
    of = lambda k: [item for _, s, _, item, _ in one if s == k]
    assert one == two and of(-2) == [1, 3, 5, 7] and of(-1) == [0, 2, 4, 6] and all(len(of(k)) == 4 for k in range(3))
    assert all(b == (item % 2 == 0) for _, _, _, item, b in one)


def test_labels_narrow_from_component_to_component(spark):
    augmented = spark.createDataFrame([("a", 100 + i) for i in range(2)] + [("b", 200 + i) for i in range(5)], "component string, item long")
    got = sampling.narrowing_demo_sets(augmented, spark.range(50).withColumnRenamed("id", "item"), ["a", "b", "c"], 3, 8, 1).toPandas()
    labels = {c: {*own[~own.bootstrapped]["item"]} for c, own in got.groupby("component")}
    assert [len(labels[c]) for c in "abc"] == [6, 5, 5] and labels["b"] <= labels["a"] and labels["c"] <= labels["b"]
    assert all(sorted(own.nth) == [*range(1, len(own) + 1)] for _, own in got.groupby("component"))


def test_long_chains_and_cycles(spark):
    steps = spark.createDataFrame([(i, i - 1 if i else None) for i in range(200)] + [(1000 + i, 1000 + i // 3 if i else None) for i in range(40)], "step long, prior long")
    got = {r.step: (r.depth, r.root) for r in chains.walk(steps).collect()}
    assert all(got[i] == (i, 0) for i in range(200)) and all(got[1000 + i][1] == 1000 for i in range(40))
    evidence = spark.createDataFrame([(i, f"e{i // 3}") for i in range(200)] + [(1000 + i, f"x{i % 4}") for i in range(40)], "step long, evidence string")
    up = lambda s: (s - 1 if 0 < s < 1000 else 1000 + (s - 1000) // 3 if s > 1000 else None)
    of, want = {r.step: r.evidence for r in evidence.collect()}, set()
    for s, e in of.items():
        at = up(s)
        while at is not None and of[at] != e:
            at = up(at)
        if at is None:
            want.add((s, e))
    assert {(r.step, r.evidence) for r in chains.owed(steps, evidence).collect()} == want
    with pytest.raises(ValueError, match="itself"):
        chains.walk(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "step long, prior long"))
    with pytest.raises(ValueError, match="isn't there"):
        chains.walk(spark.createDataFrame([(1, None), (2, 9)], "step long, prior long"))


def test_numbers_over_ranges_made_by_size(spark):
    r = random.Random(16)
    rows = [(r.choice("aab"), r.random(), i, "own") for i in range(500)]
    df = spark.createDataFrame(rows, "k string, p double, i long, chunk string").repartition(4)
    got = {x.i: x for x in logs.numbered(logs.numbered(df, ["k"], None, ["p", "i"], "n"), ["k"], F.floor(F.col("n") / 50), ["n"], "most", "i", F.max).collect()}
    count, most = {}, {}
    for k, _, i, _ in sorted(rows, key=lambda x: (x[1], x[2])):
        count[k], most[k] = count.get(k, 0) + 1, max(most.get(k, -1), i)
        assert (got[i].n, got[i].most, got[i].chunk) == (count[k], most[k], "own")


def test_holm_refuses_what_is_no_p_value(spark):
    for bad in (None, 1.5, -0.1, math.nan):
        with pytest.raises(Exception, match="not a p-value"):
            S.holm(spark.createDataFrame([("f", 1, 0.5), ("f", 2, bad)], "family string, id long, p double"), "p", "id", ["family"]).collect()


def test_records(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"version": 1, "pools": {"p": {"train": ["a", "b"], "val": ["c"], "test": ["b"]}}, "historical_pass_rates": {"a": 0.5}}')
    members = records.read_manifest(spark, str(tmp_path / "m.json"))
    assert members.count() == 4 and [r.task_id for r in records.manifest_conflicts(members).collect()] == ["b"]
    new = spark.createDataFrame([("s", 1), ("s", 1), ("s", 2)], "schema string, v long").withColumn("content_hash", records.content_hash("schema", "v"))
    path = str(tmp_path / "store")
    records.put_records(new, None, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 2 and records.put_records(new, stored, path).count() == 0
    refs = new.select("content_hash").distinct().unionByName(spark.createDataFrame([("no",)], "content_hash string"))
    assert records.get_records(refs, stored, "s").filter("problem IS NOT NULL").count() == 1
    cache = spark.createDataFrame([("k", 1, "old")], "key string, at long, value string")
    got = records.insert_absent(spark.createDataFrame([("k", 0, "x"), ("l", 5, "late"), ("l", 3, "early")], cache.schema), cache)
    assert {(r.key, r.value) for r in got.collect()} == {("k", "old"), ("l", "early")}


def test_logs_of_entries(spark, tmp_path):
    log = tmp_path / "log"
    schema = "at string, unit string"
    assert records.scan_log(spark, str(log), schema).count() == 0
    log.mkdir()
    for name, at in (("b", "2"), ("a", "2"), ("c", "1")):
        (log / f"entry-{name}.json").write_text(f'{{"at": "{at}", "unit": "{name}"}}')
    (log / "tmp-1").write_text("half")
    assert [r.unit for r in records.scan_log(spark, str(log), schema).collect()] == ["c", "a", "b"]
    (log / "notes.txt").write_text("x")
    for f in (lambda: records.scan_log(spark, str(log), schema), lambda: records.truncate_log(spark, str(log))):
        with pytest.raises(ValueError, match="notes.txt"):
            f()
    (log / "notes.txt").unlink()
    (log / "entry-d.json").write_text('{"at": "3", "uni')
    with pytest.raises(Exception, match="(?i)malformed|corrupt|failfast"):
        records.scan_log(spark, str(log), schema).collect()
    records.truncate_log(spark, str(log))
    assert not log.exists()


def test_documents_and_costs(spark):
    rows = spark.createDataFrame([('{"b":1,"a":[1,{"d":2,"c":null}]}', '{"a" : [1, {"c":null,"d":2}], "b": 1}'), ('{"a":[1,2]}', '{"a":[2,1]}'), ('{"a":NaN}', None)], "x string, y string")
    got = rows.select((D.canonical(F.col("x")) == D.canonical(F.col("y"))).alias("e"), D.json_problem(F.col("x")).alias("p")).collect()
    assert [(r.e, r.p) for r in got] == [(True, None), (False, None), (None, "not JSON")]
    numbers = [0.0, 1.0, 0.5, 0.1, 0.0001, 0.00012, 0.001, 0.00099, 1e-5, 1.25e-7, 0.123456789]
    got = spark.createDataFrame([(x,) for x in numbers], "x double").select(D.float_token(F.col("x")).alias("t")).collect()
    assert [r.t for r in got] == [repr(x) for x in numbers]
    texts = ["plain", "a\\b\n\r\t", "é日😀\x01", "", "x" * 1025, " \x00 "]
    got = spark.createDataFrame([(x,) for x in texts], "x string").select("x", D.escaped(F.col("x")).alias("e"), D.unescaped(D.escaped(F.col("x"))).alias("u"), D.bounded(F.col("x"), "code").alias("b")).collect()
    assert [r.u for r in got] == texts and [r.e for r in got] == [x.encode("unicode-escape").decode("ascii") for x in texts]
    assert [len(r.b) for r in got[:3]] == [5, 6, 4] and got[3].b == got[5].b == "<unprintable code>" and len(got[4].b) == 1024


def test_evidence_is_paid_once(spark):
    ref = lambda s, h: {"schema": s, "content_hash": h}
    steps = spark.createDataFrame([
        ("r", [ref("eval_evidence", "a")], None, [ref("eval_evidence", "a"), ref("note", "z")], '{"evidence_ref": {"schema": "eval_failure", "content_hash": "f"}}'),
        ("r", [ref("eval_evidence", "a"), ref("eval_evidence", "lost")], [], None, "not json"), ("s", None, [ref("eval_evidence", "a")], None, '{"evidence_ref": {"schema": "eval_evidence", "content_hash": "b"}}'), ("s", None, None, None, '{"evidence_ref": 5}'),
    ], f"run_id string, intent_refs array<{spend.REF}>, search_refs array<{spend.REF}>, tool_refs array<{spend.REF}>, tool_details string")
    evidence = spark.createDataFrame([("eval_evidence", "a", "oa"), ("eval_failure", "f", "of"), ("eval_evidence", "b", None)], "schema string, content_hash string, outputs_hash string")
    row = "struct<prompt_tokens:long,completion_tokens:long,provider_cost:double,cache_hit:boolean,missing:boolean,failed:boolean,provider_error:string>"
    rows = [(1, 2, 0.5, False, False, False, None), (None, None, None, False, False, True, '{"rejected_response": {}}'), (None, None, None, False, False, True, "{}")]
    kept = spark.createDataFrame([("oa", rows), ("of", rows[:1])], f"content_hash string, outputs array<{row}>")
    calls = spark.createDataFrame([("r", "c1", 1, 1, 1.0), ("r", "c1", 1, 1, 1.0), ("s", "c1", 1, 1, 1.0), ("r", "", 1, 1, 1.0), ("r", "", 1, 1, 1.0), ("r", None, 1, 1, 1.0)], "run_id string, call_id string, prompt_tokens long, completion_tokens long, provider_cost double")
    got = {(r.role, r.run_id): (r.calls, r.priced, r.usd) for r in spend.run_cost(steps, evidence, kept, calls).collect()}
    assert got == {("task_model", "r"): (3, 2, None), ("task_model", "s"): (2, 1, None), ("proposer", "r"): (4, 4, 4.0), ("proposer", "s"): (1, 1, 1.0)}


def test_numbers_within_large_groups(spark):
    r = random.Random(6)
    rows = [(r.choice("aab"), i, r.randrange(9)) for i in r.sample(range(5000), 400)]
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(4)
    got = {x.o: (x.n, x.total) for x in logs.numbered(logs.numbered(df, ["k"], F.floor(F.col("o") / 100), ["o"], "n"), ["k"], F.floor(F.col("o") / 70), ["o"], "total", "v").collect()}
    count, total = {}, {}
    for k, o, v in sorted(rows, key=lambda x: x[1]):
        count[k], total[k] = count.get(k, 0) + 1, total.get(k, 0) + v
        assert got[o] == (count[k], total[k])


def test_round_stats_over_rounds(spark):
    r = random.Random(8)
    rows = [(i, i // 5, f"i{r.randrange(30)}", float(r.randrange(40))) for i in range(150)]
    got = {x.round_index: x for x in ranking.round_stats(spark.createDataFrame(rows, "ordinal long, round_index long, instruction string, reward double"), 4).collect()}
    for at in range(30):
        best, first = {}, {}
        for o, rd, name, reward in rows:
            if rd <= at:
                first.setdefault(name, o)
                best[name] = max(best.get(name, -1.0), reward)
        top = sorted(best, key=lambda n: (-best[n], first[n]))[:4]
        assert (got[at].n_best, got[at].best_max, got[at].best_min) == (len(top), best[top[0]], best[top[-1]])
