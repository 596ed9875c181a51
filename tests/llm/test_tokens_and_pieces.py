from __future__ import annotations

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from evalfold.llm.sentence_pieces import Pieces, encode, encode_long, sample_pieces
from evalfold.llm.token_counts import PreTokens, _packed, _unpacked, token_counts
from evalfold.llm.words import mix

from .conftest import rows

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("entries", [1_000_000, 5])
def test_counts_equal_the_library(docs, entries):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    text = {i: t or "" for i, t, *_ in rows()}
    got = token_counts(docs, BPE, block_entries=entries).toPandas()
    assert len(got) == len(rows())
    for r in got.itertuples():
        n = len(library.encode(text[r.doc_id], add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text[r.doc_id].encode()), n, n > 1024)


def test_counts_of_rows_in_another_order_each_time(spark):
    import uuid

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    text = {i: "word " * (i % 7) + f"number{i} and internationalisation{i * i}" for i in range(300)}
    docs = spark.createDataFrame([*text.items()], "doc_id long, text string")
    # Python's uuid4 gives another order in each evaluation, as fetched blocks of a shuffle may.
    shuffled = docs.repartition(2).mapInPandas(lambda frames: (x.assign(o=[uuid.uuid4().hex for _ in range(len(x))]).sort_values("o")[["doc_id", "text"]] for x in frames), docs.schema)
    got = {r.doc_id: r.n_tokens for r in token_counts(shuffled, BPE, block_entries=50).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False)) for i, t in text.items()}


def test_blocks_of_any_size_come_back():
    r = np.random.default_rng(3)
    for n_docs, n_words in ((1, 1), (7, 40), (200, 70_000)):
        sizes = r.integers(0, min(n_words, 60) + 1, n_docs).astype(np.int32)
        index = np.concatenate([r.choice(n_words, k, replace=False) for k in sizes] or [np.zeros(0)]).astype(np.int32)
        freq = r.integers(1, 2**31, len(index)).astype(np.int32)
        order, cells = _packed(sizes, index, freq, n_words)
        number, times = _unpacked(cells, sizes)
        bounds = np.cumsum(sizes)[:-1]
        for old, new, f, t in zip(*(np.split(x, bounds) for x in (index, order[number], freq, times))):
            assert dict(zip(old.tolist(), f.tolist())) == dict(zip(new.tolist(), t.tolist()))


def test_splitting_equals_the_library():
    from tokenizers import Tokenizer

    library, own, r = Tokenizer.from_file(BPE), PreTokens.of(BPE), random.Random(1)
    parts = [*"ab Z09'\n\t  s't!é²ß —日ªº́<|>.\x1c\x85­ ", "<|endoftext|>", "'re", "  ", "\r\n", "\U0001d7d8", "😀", "ǅ"]
    for _ in range(3000):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        words = own.split(s)
        assert "".join(words) == s and sum(own.pieces(words)) == len(library.encode(s, add_special_tokens=False))


def test_empty_tables(no_docs):
    assert token_counts(no_docs, BPE).count() == 0 and sample_pieces(no_docs, PIECES).count() == 0


def test_pieces_are_lossless_and_reproducible(docs):
    first, again = (sample_pieces(docs.repartition(n), PIECES).toPandas() for n in (2, 7))
    text = {i: t or "" for i, t, *_ in rows()}
    assert all(r.decoded == text[r.doc_id] and r.n_pieces == len(r.pieces) for r in first.itertuples())
    one, two = ({r.doc_id: list(r.pieces) for r in x.itertuples()} for x in (first, again))
    assert one == two
    assert sample_pieces(docs, PIECES, seed=2).count() == len(rows())


def test_library_decodes_what_is_sampled():
    import sentencepiece

    library, own, r = sentencepiece.SentencePieceProcessor(model_file=PIECES), Pieces.of(PIECES), random.Random(2)
    texts = ["".join(r.choice([*"ab cdefé日\n\t  \x00😀́", "the ", "    ", "<0x41>"]) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    ids, bounds = encode(texts, mix(np.arange(1500, dtype=np.uint64)), own)
    for text, a, b in zip(texts, bounds[:-1], bounds[1:]):
        assert library.decode(ids[a:b].tolist()) == text
    data, starts = own.decode(ids, bounds)
    assert [data[a:b].tobytes().decode() for a, b in zip(starts[:-1], starts[1:])] == texts
    literal = ["a▁b ▁ ▁▁", "", "▁"]
    assert own.decode(*encode(literal, np.arange(3, dtype=np.uint64), own))[0].tobytes().decode() == "".join(literal)


def test_long_texts_in_runs_have_the_same_pieces():
    own, r = Pieces.of(PIECES), random.Random(5)
    text = "".join(r.choice([*"ab cdefé日\n\t  😀", "the ", " words", "▁"]) for _ in range(4000))
    seed = mix(np.array([7], dtype=np.uint64))
    want, _ = encode([text], seed, own)
    for limit in (1, 50, 10**6):
        assert (encode_long(text, seed, own, limit=limit) == want).all()
    assert not len(encode_long("", seed, own))


@pytest.mark.parametrize("word", ["hello", "naïves"])
def test_samples_follow_the_lattice(word):
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), Pieces.of(PIECES)
    weight, _ = own.weights(1.0)

    def every(s):
        if not s:
            yield (), 0.0
        for n in range(1, len(s) + 1):
            i = library.piece_to_id(s[:n])
            if library.id_to_piece(i) == s[:n]:
                for rest, w in every(s[n:]):
                    yield (i, *rest), weight[i] + w

    odds = {ids: np.exp(w) for ids, w in every("▁" + word)}
    total = sum(odds.values())
    n = 20_000
    ids, bounds = encode([word] * n, mix(np.arange(n, dtype=np.uint64)), own)
    got = Counter(tuple(ids[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:]))
    assert set(got) <= set(odds)
    for ids, o in odds.items():
        p = o / total
        assert abs(got[ids] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-4
