from __future__ import annotations

import hashlib
import zlib

import duckdb
import pytest

from evalfold.llm.queries import ORACLES, QUERIES

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(ORACLES[name]).to_arrow_table()
    got = QUERIES[name](spark, SF).select(*want.column_names).toArrow()
    rows = lambda t: sorted(repr([r[c] for c in want.column_names]) for r in t.to_pylist())
    assert rows(got) == rows(want)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows_of(spark, name, texts):
    got = {r.doc_id: r for r in QUERIES[name](spark, SF).collect()}
    assert set(got) == set(texts)
    return got


def test_op2_query(spark, texts):
    got = rows_of(spark, "op2_sharding", texts)
    for i, r in got.items():
        assert (r.size, r.text_crc32, r.law) == (len(texts[i].encode()) + 1, zlib.crc32(texts[i].encode()), "key")
        assert 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8)
    for shard in range(8):
        slots = sorted(r.slot for r in got.values() if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_op3_query(spark, texts):
    want = brute.near([*texts.items()], 2)
    for i, r in rows_of(spark, "op3_near_dedup", texts).items():
        assert (r.n_shingles, r.component_id, r.kept) == (len(brute.shingles(texts[i], 2)), want[i], want[i] == i)


def test_op4_query(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, r in rows_of(spark, "op4_token_counts", texts).items():
        n = len(library.encode(texts[i], add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[i].encode()), n, n > 1024)


def test_op5_query(spark, texts):
    planted = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL", "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "All rights reserved.": "Proprietary"}
    for i, r in rows_of(spark, "op5_license_scan", texts).items():
        want = sorted({family for line, family in planted.items() if line in texts[i]})
        runs = [bool(brute.words(x)) for x in texts[i].split("\n")]
        assert r.families == ",".join(want) and r.n_paragraphs == sum(b and not a for a, b in zip([False, *runs], runs))


def test_op6_query(spark, texts):
    import public_tokenizers
    import sentencepiece

    from evalfold.llm.sentence_pieces import sample_pieces

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = {r.doc_id: list(r.pieces) for r in sample_pieces(spark.read.parquet(f"{SF}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model")).collect()}
    for i, r in rows_of(spark, "op6_sentence_pieces", texts).items():
        assert r.lossless and r.n_pieces == len(pieces[i]) and r.pieces_sha256 == hashlib.sha256(",".join(map(str, pieces[i])).encode()).hexdigest()
        assert library.decode(pieces[i]) == texts[i]


def test_op8_query(spark, texts):
    got = rows_of(spark, "op8_quality", texts)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(got[i].kept for i, q in labels.items() if q == 1) >= 0.98 * sum(labels.values())
    assert sum(not got[i].kept for i, q in labels.items() if q == 0) >= 0.9 * sum(q == 0 for q in labels.values())
    # Whatever stays has a larger key than whatever goes.
    assert min(r.gumbel_key for r in got.values() if r.kept) > max(r.gumbel_key for r in got.values() if not r.kept)


def test_op10_query(spark, texts):
    names = ("assign", "access", "hex")
    for i, r in rows_of(spark, "op10_secret_scan", texts).items():
        base = brute.secrets(texts[i])
        text = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) <= set(r.spans.split(",")) and len([x for x in r.spans.split(",") if x]) == len(base) + r.n_markov
