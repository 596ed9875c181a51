from __future__ import annotations

import hashlib
import os
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from evalfold.llm import exact_dedup as E
from evalfold.llm import sharding as S

from .conftest import EXTRA, rows


def test_index_resolves_every_document(docs):
    d = E.digests(docs)
    got = E.resolve(d, *E.build_index(d)).toPandas()
    by = defaultdict(list)
    for i, t, *_ in rows():
        by[hashlib.sha256((t or "").encode()).digest()].append(i)
    assert len(got) == len(rows()) and got.historical.all()
    for r in got.itertuples():
        assert (r.keep_id, r.group_size) == (max(by[bytes(r.digest)]), len(by[bytes(r.digest)]))


def test_latest_stays_through_both_branches(docs, no_docs, spark):
    got = E.latest_stays(docs).toPandas()
    by = defaultdict(list)
    for i, t, *_ in rows():
        by[hashlib.sha256((t or "").encode()).digest()].append(i)
    assert len(got) == len(rows()) and 0 < got.historical.sum() < len(got)
    for r in got.itertuples():
        assert (r.keep_id, r.group_size) == (max(by[bytes(r.digest)]), len(by[bytes(r.digest)]))
    assert E.latest_stays(no_docs).count() == 0
    alone = E.latest_stays(spark.createDataFrame([(None, "a"), (None, "a"), (5, "b"), (None, "b")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size) for r in alone) == [(0, 0, 2), (0, 0, 2), (0, 5, 2), (5, 5, 2)]


def test_nonmembers_group_apart(spark):
    old = E.digests(spark.createDataFrame([(900, "seen"), (901, "seen too")], "doc_id long, text string"))
    new = E.digests(spark.createDataFrame([(1, "seen"), (2, "new"), (3, "new"), (None, "new"), (None, "alone")], "doc_id long, text string"))
    got = {(r.doc_id, bytes(r.digest)[:1]): r for r in E.resolve(new, *E.build_index(old)).collect()}
    found = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.historical) for r in got.values())
    assert (1, 900, 1, True) in found and (2, 3, 3, False) in found and (3, 3, 3, False) in found
    assert E.resolve(new, *E.build_index(old.limit(0))).count() == 5


def test_hash_is_minimal_and_perfect(spark):
    index, _ = E.build_index(E.digests(spark.range(3000).selectExpr("id AS doc_id", "CAST(id AS string) AS text")))
    slots = [s for r in index.collect() for s in r.slots]
    assert len(slots) == 3000 and len({s.keep_id for s in slots}) == 3000
    for r in index.collect():
        assert r.starts[-1] == len(r.slots) and max(b - a for a, b in zip(r.starts, r.starts[1:])) <= E.LEAF_MAX


def test_slots_are_numbered_through_the_whole_index(spark, monkeypatch):
    monkeypatch.setattr(E, "RUN", 4)  # several runs and blocks of runs
    d = E.digests(spark.range(3000).selectExpr("id AS doc_id", "CAST(id % 2000 AS string) AS text"))
    strangers = E.digests(spark.range(500).selectExpr("id AS doc_id", "concat('x', id) AS text"))
    index, buckets = E.build_index(d)
    got = E.lookup(d.unionByName(strangers), index, buckets).toPandas()
    known = got[got.slot.notna()]
    assert len(known) == 3000 and sorted(set(known.slot.astype(int))) == list(range(2000))
    assert known.groupby("slot").digest.nunique().max() == 1 and known.groupby("digest").slot.nunique().max() == 1


def test_empty_table(no_docs):
    d = E.digests(no_docs)
    assert E.resolve(d, *E.build_index(d)).count() == 0
    assert S.shard_documents(no_docs, S.fleet(8), S.fleet(9)).count() == 0


def test_shards_follow_the_key_law(spark, docs):
    many = spark.range(4000).selectExpr("id AS doc_id", "repeat('x', CAST(id % 7 AS int)) AS text")
    got = S.shard_documents(many, S.fleet(8), S.fleet(9)).toPandas()
    assert ((got.grown_shard == got.shard) | (got.grown_shard == 8)).all()
    assert 0.08 < (got.grown_shard == 8).mean() < 0.14
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own))) and 400 < len(own) < 600
    edge = S.shard_documents(docs, S.fleet(8), S.fleet(9)).toPandas()
    text = Counter((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t, *_ in rows())
    assert Counter(zip(edge.doc_id, edge.text_crc32, edge["size"])) == text
    assert edge.groupby("doc_id")["shard"].nunique().max() == 1


def test_movement_stays_in_changed_subtrees(spark):
    from pyspark.sql import functions as F

    before = S.fleet(8)
    after = [S.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in before]
    got = spark.range(6000).select(S.shard_of(F.col("id"), before).alias("a"), S.shard_of(F.col("id"), after).alias("b")).toPandas()
    moved = got[got.a != got.b]
    # Shard 5 gains weight: region 1 and its first rack do too; rows leave what lost share and come to region 1 or stay in it.
    assert len(moved) and (moved.b >= 4).all()
    assert (got[got.a == 5].b == 5).all()


def test_draws_equal_a_plain_descent(spark):
    import math

    import xxhash
    from pyspark.sql import functions as F

    leaves = [S.Leaf(x.region, x.rack, x.shard, 1.0 + x.shard % 3) for x in S.fleet(10)]

    def draw(key, path, weight):
        h = xxhash.xxh64_intdigest(path.encode(), seed=xxhash.xxh64_intdigest(key.to_bytes(8, "little"), seed=42))
        return -math.log(((h >> 11) + 0.5) / (1 << 53)) / weight

    def descend(key, own, depth, path):
        by = defaultdict(list)
        for x in own:
            by[(x.region, x.rack, x.shard)[depth]].append(x)
        best = min(sorted(by), key=lambda n: draw(key, f"{path}/{n}", sum(x.weight for x in by[n]))) if len(by) > 1 else [*by][0]
        return by[best][0].shard if depth == 2 else descend(key, by[best], depth + 1, f"{path}/{best}")

    got = spark.range(700).select("id", S.shard_of(F.col("id"), leaves).alias("shard")).collect()
    assert [r.shard for r in got] == [descend(r.id, leaves, 0, "") for r in got]


def test_slots_leave_other_columns_alone(spark):
    rows_ = spark.range(300).selectExpr("id", "id % 3 AS shard", "'a' AS bucket", "'b' AS row", "'c' AS start", "'d' AS _bucket", "'e' AS slot", "'f' AS rows_in")
    got = S.with_slots(rows_, "shard", ["id"], 5).toPandas()
    assert set(got.columns) == set(rows_.columns)
    assert (got.bucket == "a").all() and (got.row == "b").all() and (got.start == "c").all()
    assert all(sorted(own.slot) == list(range(100)) for _, own in got.groupby("shard"))


def test_null_ids_have_a_shard(spark):
    got = S.shard_documents(spark.createDataFrame([(None, "a"), (None, None)], EXTRA.split(",")[0] + ", text string"), S.fleet(8), S.fleet(9)).collect()
    assert len(got) == 2 and sorted(r.slot for r in got) == [0, 1]


def test_workspace_restores_the_session(spark):
    from evalfold.llm.common import small_batches, staged, workspace
    from evalfold.sources.staging import own_dir

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, "10000")
    with workspace(spark):
        staged(small_batches(spark.range(3)), "numbers").count()
        assert spark.conf.get(name) == "1000"
    assert spark.conf.get(name) == "10000" and not os.path.exists(own_dir(spark).removeprefix("file://"))
    spark.conf.set(name, was)


def test_a_cluster_needs_a_shared_folder():
    import pytest

    from evalfold.llm.common import shared_dir

    class Cluster:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster)


def test_staged_tables_can_be_cleared(spark):
    from evalfold.llm.common import clear_staged, staged
    from evalfold.sources.staging import own_dir

    assert staged(spark.range(3).toDF("n"), "numbers").count() == 3
    folder = own_dir(spark).removeprefix("file://")
    assert os.path.isdir(folder)
    clear_staged(spark)
    assert not os.path.exists(folder)


def test_a_look_up_joins_two_exchanged_sides(spark):
    """Whatever the index was made of, so that adaptive execution can split a hot digest."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.sha2(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")), 256).alias("digest"))
    docs = docs.withColumn("digest", F.unhex("digest"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = E.lookup(docs, *E.build_index(docs))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 1 and plan.count("Exchange hashpartitioning(bucket") == 2
        assert found.filter("hit IS NULL").count() == 0 and found.select("slot").distinct().count() == 2001
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
