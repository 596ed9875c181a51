"""Token counts: pieces are counted once for each distinct pre-token and joined to per-document pre-token frequencies.

1. One scan splits the texts. Documents are taken in blocks (what a task reads, up to BLOCK_ENTRIES entries): a block is one
   row with its vocabulary of distinct pre-tokens, most frequent first, and a sparse matrix of the numbers of each document's
   pre-tokens in it and how often each occurs. The blocks are written to the shared folder, so both sides of the later
   join read the same rows, in whatever order and however often they came before.
2. The vocabularies' entries (pre-token, block, number) are dealt by pre-token and sorted; the tokenizer sees each distinct
   pre-token once and reports only how many pieces it has. A very common pre-token comes once a block, not once a row.
3. The counts go back to their blocks as arrays and meet the matrix there: a document's tokens are the sum of frequency
   times count. Ids of a document are never made, and only distinct entries and small integers are shuffled, not texts.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalfold.llm.common import read, small_batches, staged

#: Entries of the sparse matrix after which a block ends (with the document that reaches it).
BLOCK_ENTRIES = 4_000_000
#: Vocabulary entries of a task that counts pieces, and blocks of one that sums them.
TASK_ENTRIES, TASK_BLOCKS = 300_000, 4
#: Tokens over which a document is reported as over the limit.
LIMIT = 1024

#: The pre-tokenizer's pattern for texts of the characters that PLAIN covers, where L, N and white space are these ranges.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t\n\r "
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ɏ‐-‧€]*")
_FAST = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


class PreTokens:
    """Splits texts as the tokenizer file does before its merges; made once for each worker process."""

    _made: dict[str, PreTokens] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            d = json.load(f)
        if d["model"]["type"] != "BPE" or d["normalizer"] is not None or d["post_processor"] is not None or {k: (d["pre_tokenizer"] or {}).get(k) for k in ("type", "add_prefix_space", "use_regex")} != {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}:
            raise ValueError("only byte-level BPE files without normalizer, prefix space and post-processor are split here")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in d["added_tokens"]):
            raise ValueError("added tokens that look at their neighbours aren't handled")
        added = sorted((t["content"] for t in d["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None

    @classmethod
    def of(cls, path: str) -> PreTokens:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text in order; an added token's string is one of its own."""
        if self.added is not None and self.added.search(text):
            out, at = [], 0
            for m in self.added.finditer(text):
                out += self._plain(text[at : m.start()])
                out.append(m[0])
                at = m.end()
            return out + self._plain(text[at:])
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return _FAST.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, words: list[str]) -> list[int]:
        """How many pieces each pre-token has."""
        return [len(e) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]


def _blocks(batches: Iterator[pa.RecordBatch], path: str, entries: int) -> Iterator[pa.RecordBatch]:
    """Rows ids, n_bytes, sizes (entries of each document), words, cells: one for each block."""
    split = PreTokens.of(path).split

    def block() -> pa.RecordBatch:
        order, cells = _packed(np.frombuffer(sizes, np.int32), np.frombuffer(index, np.int32), np.frombuffer(freq, np.int32), len(words))
        names = [*words]
        columns = [(ids, pa.int64()), (n_bytes, pa.int64()), (np.frombuffer(sizes, np.int32), pa.int32()), ([names[i] for i in order.tolist()], pa.string())]
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.list_(t)) for x, t in columns), pa.array([cells], pa.binary())], names=["ids", "n_bytes", "sizes", "words", "cells"])

    ids, n_bytes, sizes, index, freq, words = [], [], array("i"), array("i"), array("i"), {}
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            counts = Counter(split(text)) if text else {}
            ids.append(doc)
            n_bytes.append(len(text.encode()) if text else 0)
            sizes.append(len(counts))
            index.extend([words.setdefault(w, len(words)) for w in counts])
            freq.extend(counts.values())
            if len(index) >= entries:
                yield block()
                ids, n_bytes, sizes, index, freq, words = [], [], array("i"), array("i"), array("i"), {}
    if ids:
        yield block()


def _planes(values: np.ndarray) -> bytes:
    """32-bit numbers byte by byte: the upper bytes are nearly all zero, so they compress to nothing."""
    return np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _packed(sizes: np.ndarray, index: np.ndarray, freq: np.ndarray, n_words: int) -> tuple[np.ndarray, bytes]:
    """The words' old numbers by falling number of documents, and the matrix: of each document its words' new numbers in
    order, as steps from one to the next, and their frequencies."""
    order = np.argsort(-np.bincount(index, minlength=n_words), kind="stable")
    rank = np.empty(n_words, np.int64)
    rank[order] = np.arange(n_words)
    keys = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) * max(n_words, 1) + rank[index]
    at = np.argsort(keys)
    number = keys[at] % max(n_words, 1)
    steps = np.diff(number, prepend=0)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    steps[starts] = number[starts]
    return order, zlib.compress(_planes(steps) + _planes(freq[at]), 1)


def _unpacked(cells: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' numbers and frequencies."""
    steps, freq = (np.ascontiguousarray(x.T).view("<i4")[:, 0] for x in np.frombuffer(zlib.decompress(cells), np.uint8).reshape(2, 4, -1))
    number = np.cumsum(steps, dtype=np.int64)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    return number - np.repeat(number[starts] - steps[starts], sizes[sizes > 0]), freq


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of `docs` (doc_id, text).

    path: a byte-level BPE tokenizer file that every executor can open. Counts are those of the library without special
    tokens added; strings of special tokens inside a text count as one token. A null or empty text has 0 bytes and tokens.
    Rows that repeat, or lack a doc_id, are each reported.
    """
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _blocks(batches, path, block_entries)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PreTokens.of(path).pieces
        last, n_last = None, 0
        for batch in batches:
            words = batch.column("word").to_pylist()
            # Equal pre-tokens are neighbours; the first of a batch may have ended the one before.
            first = [i for i, w in enumerate(words) if w != (words[i - 1] if i else last)]
            counts = np.array([n_last, *pieces([words[i] for i in first])], dtype=np.int32)
            starts = np.zeros(len(words), dtype=np.int64)
            starts[first] = 1
            n = counts[np.cumsum(starts)]
            last, n_last = words[-1], int(n[-1])
            block, entry = batch.column("block").to_numpy(), batch.column("entry").to_numpy()
            order = np.lexsort((entry, block))
            blocks, begin = np.unique(block[order], return_index=True)
            offsets = pa.array(np.append(begin, len(block)), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(blocks), *(pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in (entry, n))], names=["block", "entries", "pieces"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                got = lambda name: batch.column(name)[i].values  # noqa: B023, E731
                sizes = got("sizes").to_numpy()
                index, freq = _unpacked(batch.column("cells")[i].as_py(), sizes)
                n = np.zeros(int(index.max(initial=0)) + 1, dtype=np.int64)
                if batch.column("entries")[i].is_valid:
                    n[got("entries").flatten().to_numpy()] = got("pieces").flatten().to_numpy()
                sums = np.append(0, np.cumsum(freq * n[index]))
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([got("ids"), got("n_bytes"), pa.array(sums[ends] - sums[ends - sizes])], names=["doc_id", "n_bytes", "n_tokens"])

    blocks = small_batches(docs).select("doc_id", "text").mapInArrow(made, "ids array<long>, n_bytes array<long>, sizes array<int>, words array<string>, cells binary")
    # The number is fixed once it is written; a task that is run again before that may number its blocks anew.
    blocks = staged(blocks.withColumn("block", F.monotonically_increasing_id()), "token-blocks", "zstd")
    n_blocks, n_entries = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    entries = blocks.select("block", F.posexplode("words").alias("entry", "word"))
    # Equal pre-tokens come together so that they are counted once; where one is in very many blocks, adaptive execution may part it.
    entries = entries.hint("rebalance", n_entries // TASK_ENTRIES + 1, "word").sortWithinPartitions("word")
    counts = entries.mapInArrow(count, "block long, entries array<int>, pieces array<int>").repartition(n_blocks // TASK_BLOCKS + 1, "block")
    counts = counts.groupBy("block").agg(F.collect_list("entries").alias("entries"), F.collect_list("pieces").alias("pieces"))
    sums = blocks.drop("words").repartition(n_blocks // TASK_BLOCKS + 1, "block").join(counts, "block", "left").mapInArrow(total, "doc_id long, n_bytes long, n_tokens long")
    return sums.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by the tokenizer file byte_bpe_50k.json."""
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
