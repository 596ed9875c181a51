"""Quality classifier by importance resampling.

Two generative models of hashed word n-grams (bags of single tokens and of pairs of neighbours) are estimated: one of target
text, from labelled good documents, and one of the raw text, from all documents. A document's log importance weight is
the sum over its n-grams of log p_target - log p_raw, both without its own text, tempered for long texts. Resampling without replacement is Gumbel top-k: each document's key is its log weight
plus Gumbel noise drawn from its doc_id, and the k largest keys stay. k is the number of documents whose weight reaches a
cutoff fitted on labelled documents, so it follows the input and no share is set beforehand.

Two scans of the texts: one counts (each task sends one table of BUCKETS counts at most, pre-aggregated), one scores. Only
(doc_id, weight) rows are written between. The k-th largest key is found by repeated histograms of at most BINS rows, so
neither a sort of all keys nor the keys themselves meet in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalfold.llm.arrow import blocks
from evalfold.llm.common import read, small_batches, staged
from evalfold.llm.words import Words, mix, word_bytes

HASHED = 1 << 14
#: Lengths of runs of one token that have a bucket of their own.
RUNS = 8
BUCKETS = HASHED + RUNS
#: Labelled documents of each class that are used (a documented bound; the ones with the least hashes of their ids).
LABELLED = 20_000
#: Added to the observed and the expected count of each bucket, so that rare n-grams say little.
PRIOR = 10.0
#: N-grams that a longer text counts for: its weight is the mean of its n-grams times this, so length alone decides nothing.
LENGTH = 100.0
#: What a wrongly rejected good document weighs against a wrongly kept bad one when the cutoff is fitted.
GOOD_WEIGHT = 4.0
BINS = 4096
BLOCK_BYTES = 1 << 20
#: Kinds of bytes: 1 letters, digits and all beyond ASCII; 2 punctuation; 0 white space and controls.
KINDS = word_bytes(lambda c: 48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123 or c >= 128).astype(np.uint8) + 2 * word_bytes(lambda c: 33 <= c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 127).astype(np.uint8)


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of each of a run of texts: text, bucket, occurrences.

    A token that repeats the one before counts in a bucket of its place in the run (up to RUNS) instead of as a pair, so
    that repetition shows whatever the word.
    """
    w = Words(data, offsets, KINDS)
    counts = np.diff(w.first)
    owner = np.repeat(np.arange(len(counts)), counts)
    hashes = w.hashes(np.arange(len(w.starts)))
    inside = np.flatnonzero(owner[1:] == owner[:-1]) + 1 if len(owner) else np.zeros(0, np.int64)
    a, b = hashes[inside - 1], hashes[inside]
    # The place in the run: how far the last token is that differs from the one before it (or starts a text).
    new = np.ones(len(hashes), dtype=bool)
    new[inside[a == b]] = False
    place = np.arange(len(hashes)) - np.maximum.accumulate(np.where(new, np.arange(len(hashes)), 0))
    mask = np.uint64(HASHED - 1)
    pairs = np.where(a == b, HASHED + np.minimum(place[inside], RUNS) - 1, (mix(a * np.uint64(0x9E3779B97F4A7C15) + b) & mask).astype(np.int64))
    at = np.concatenate([(hashes & mask).astype(np.int64), pairs])
    keys, times = np.unique(np.concatenate([owner, owner[inside]]) * BUCKETS + at, return_counts=True)
    return keys // BUCKETS, keys % BUCKETS, times


def _labelled(labels: DataFrame, quality: int, bound: int) -> list[int]:
    ids = labels.filter((F.col("quality") == quality) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return [r[0] for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).collect()]


def train(docs: DataFrame, target_ids: frozenset[int]) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket occurs in all documents, and in the target documents; every occurrence counts."""
    sent = docs.sparkSession.sparkContext.broadcast(target_ids)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            chosen = np.array([i in sent.value for i in batch.column("doc_id").to_pylist()], dtype=bool)
            for first, data, offsets in blocks(batch.column("text"), BLOCK_BYTES):
                owner, at, times = ngrams(data, offsets)
                raw += np.bincount(at, weights=times, minlength=BUCKETS).astype(np.int64)
                target += np.bincount(at, weights=times * chosen[first:][owner], minlength=BUCKETS).astype(np.int64)
        held = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(raw[held]), pa.array(target[held])], names=["bucket", "raw", "target"])

    counts = docs.select("doc_id", "text").mapInArrow(count, "bucket long, raw long, target long")
    table = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[table["bucket"].to_numpy()] = table["raw"].to_numpy()
    target[table["bucket"].to_numpy()] = table["target"].to_numpy()
    return raw, target


def _weights(owner: np.ndarray, at: np.ndarray, times: np.ndarray, chosen: np.ndarray, raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log weight of each text by the two models without the text itself, so that no text speaks for its own n-grams."""
    n = len(chosen)
    own_total = np.bincount(owner, weights=times, minlength=n)
    raw_total, target_total = np.maximum(raw.sum() - own_total, 1.0), np.maximum(target.sum() - own_total * chosen, 0.0)
    expected = (raw[at] - times) * (target_total / raw_total)[owner]
    seen = target[at] - times * chosen[owner]
    total = np.bincount(owner, weights=times * np.log((seen + PRIOR) / (expected + PRIOR)), minlength=n)
    sizes = np.bincount(owner, weights=times, minlength=n)
    return total * (np.minimum(sizes, LENGTH) / np.maximum(sizes, 1.0))


def log_weights(docs: DataFrame, raw: np.ndarray, target: np.ndarray, target_ids: frozenset[int]) -> DataFrame:
    """`docs` with log_weight; a text without tokens weighs 0, and so does every text where there is no target."""
    sent = docs.sparkSession.sparkContext.broadcast((raw, target, target_ids))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target, ids = sent.value
        for batch in batches:
            chosen = np.array([i in ids for i in batch.column("doc_id").to_pylist()], dtype=bool)
            weights = [np.zeros(0)]
            for first, data, offsets in blocks(batch.column("text"), BLOCK_BYTES):
                n = len(offsets) - 1
                weights.append(_weights(*ngrams(data, offsets), chosen[first : first + n], raw, target) if target.any() else np.zeros(n))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(weights))], names=[*names, "log_weight"])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "log_weight double"]))


def fit_cutoff(good: np.ndarray, bad: np.ndarray, good_weight: float = GOOD_WEIGHT) -> float:
    """The cutoff of least cost, in the middle of its gap: good documents below it cost `good_weight` shares, bad ones above it one."""
    if not len(good) or not len(bad):
        return -math.inf
    scores = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[scores[0] - 1], (scores[1:] + scores[:-1]) / 2, [scores[-1] + 1]])
    cost = good_weight * np.searchsorted(np.sort(good), cuts) / len(good) + (1 - np.searchsorted(np.sort(bad), cuts) / len(bad))
    # Of equal costs, the cut in the widest gap.
    gaps = np.concatenate([[1.0], np.diff(scores), [1.0]])
    best = np.flatnonzero(cost == cost.min())
    return float(cuts[best[np.argmax(gaps[best])]])


def kth_largest(keys: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a column without nulls, exactly; inf for k < 1, -inf for k of all rows or more."""
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if k < 1:
        return math.inf
    if k >= n:
        return -math.inf
    above = 0
    while low < high:
        x = F.col(column)
        step = F.least(F.floor((x - low) / (high - low) * BINS), F.lit(BINS - 1))
        bins = keys.filter(x.between(low, high)).groupBy(step.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for b in sorted(bins, key=lambda b: -b["bin"]):
            if above + b["n"] >= k:
                low, high = b["low"], b["high"]
                break
            above += b["n"]
    return high


def resample(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None, bound: int = LABELLED, good_weight: float = GOOD_WEIGHT) -> DataFrame:
    """The columns `carry` (doc_id where it isn't given), log_weight, gumbel_key, kept of every row of `docs`.

    labels: doc_id, quality (1 good, 0 bad; others and nulls are left out). Without good or without bad labels every
    document is kept. Rows that repeat a doc_id and text have one key and stay or go together; a row without doc_id draws
    its noise from 0. Columns of `docs` named as the new ones are replaced.
    """
    docs = small_batches(docs).drop("log_weight", "gumbel_key", "kept")
    carry = ["doc_id"] if carry is None else [c for c in carry if c in docs.columns]
    good, bad = _labelled(labels, 1, bound), _labelled(labels, 0, bound)
    target_ids = frozenset(good)
    scored = log_weights(docs.select(*dict.fromkeys([*carry, "doc_id", "text"])), *train(docs, target_ids), target_ids)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit("gumbel")), 11).cast("double") + 0.5) / float(1 << 53)
    scored = staged(scored.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))).select(*dict.fromkeys([*carry, "doc_id"]), "log_weight", "gumbel_key"), "importance")
    ids = docs.sparkSession.createDataFrame([(i, q) for q, x in ((1, good), (0, bad)) for i in x], "doc_id long, q int")
    seen = scored.select("doc_id", "log_weight").join(F.broadcast(ids), "doc_id").select("q", "log_weight").toArrow()  # at most two times `bound` ids
    q, weight = seen["q"].to_numpy(), seen["log_weight"].to_numpy()
    cutoff = fit_cutoff(weight[q == 1], weight[q == 0], good_weight)
    k = scored.filter(F.col("log_weight") >= cutoff).count()
    return scored.select(*carry, "log_weight", "gumbel_key", (F.col("gumbel_key") >= kth_largest(scored, "gumbel_key", k)).alias("kept"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, resampled towards the documents labelled good."""
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
