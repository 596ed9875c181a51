from __future__ import annotations

import corpus_pipeline as P

from . import brute

SF = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*P.COLUMNS)
    kept = []
    for name, stage in P.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, SF)
        after = {r.doc_id: r for r in docs.collect()}
        docs = spark.createDataFrame([*after.values()], docs.schema)
        kept.append((name, before, after))
        if stage is not P.STAGES[-1][1]:
            assert docs.columns == P.COLUMNS
    _, before, after = kept[0]
    assert all(before[i] == r for i, r in after.items()) and 0.8 < len(after) / len(before) < 0.95
    junk = [i for i, r in before.items() if r.text.count("!!") > 5 or r.text.count("***") > 5]
    assert junk and not set(junk) & set(after)
    _, before, after = kept[1]
    assert {i: r.text for i, r in after.items()} == {i: x[2] for i, x in brute.lines([(i, r.text) for i, r in before.items()]).items()}
    assert all(r.n_chars == len(r.text) for r in after.values())
    _, before, after = kept[2]
    assert set(after) == {i for i, c in brute.near([(i, r.text) for i, r in before.items()], 5).items() if i == c}
    _, before, after = kept[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(after) == {i for i, r in before.items() if not brute.contamination(r.text, items)[1]}
    _, before, after = kept[4]
    assert set(after) == set(before) and all(r.text == before[i].text and r.lossless and len(r.pieces) == r.n_pieces for i, r in after.items())


def test_run_is_the_stages_one_after_another(spark):
    got = P.run(spark, SF)
    assert got.count() > 100 and "pieces" in got.columns
