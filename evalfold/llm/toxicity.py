"""Toxicity by subword-bag embeddings, averaged into a linear softmax, trained jointly in numpy.

A word is what white space separates, lower-cased, without punctuation at its ends. Its vector is the mean of the
vectors of its character n-grams (3 to 6 code points of `<word>`, hashed into BUCKETS rows) with a share of WORD_SHARE for the whole
word, so a misspelling that was never seen shares most of its vectors with the word that was. A document's bag is its STRONGEST
words: those that the present model counts most towards the label, so one insult in a very long text is not averaged away,
and a clean text is judged by its most doubtful words. The mean of the bag's vectors goes into a linear softmax over the two labels.
Embeddings and softmax are trained together by minibatches with adaptive steps, first on whole texts, then on bags that are
chosen anew in each pass.

Training rows are bounded: TOXIC and CLEAN labelled documents of at most MAX_BYTES, those of the least hashes of their doc_ids. All
documents are scored, over whole texts. As the softmax is linear, a trained model is one number a bucket (BUCKETS floats are
broadcast), and a word's part is a weighted mean of its n-grams' numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalfold.llm.arrow import with_columns
from evalfold.llm.common import read, small_batches
from evalfold.llm.suffixes import expand
from evalfold.llm.words import mix

#: Labelled documents of each class that are learnt from, and bytes of the longest of them (documented bounds).
TOXIC, CLEAN, MAX_BYTES = 2000, 4000, 1 << 15
BUCKETS, DIMENSIONS, SHORTEST, LONGEST, WORD_SHARE = 1 << 18, 16, 3, 6, 0.1
STRONGEST, PASSES, BATCH, RATE, SEED = 8, 8, 32, 0.5, 7
#: Documents of the first pass, over whole texts.
WHOLE = 1500
THRESHOLD = 0.3
BLOCK_BYTES, WORD_BLOCK = 1 << 20, 1 << 13
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def split_words(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of a column of texts, the texts' words as numbers of those, and where each text's words start (and the end)."""
    split = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    words = pc.utf8_trim(split.flatten(), PUNCTUATION)
    held = pc.greater(pc.binary_length(words), 0)
    first = np.concatenate([[0], np.cumsum(held.to_numpy(zero_copy_only=False))])[split.offsets.to_numpy() - split.offsets[0].as_py()]
    named = pc.dictionary_encode(words.filter(held))
    return named.dictionary.to_pylist(), named.indices.to_numpy(zero_copy_only=False).astype(np.int64), first


def ngrams(words: list[str], block: int = WORD_BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each word's n-grams, the whole word's last, and where each word's start (and the end); made for `block` words at a time."""
    parts = [_ngrams(words[k : k + block]) for k in range(0, max(1, len(words)), block)]
    return np.concatenate([b for b, _ in parts]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for _, f in parts]))])


def _ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts, owner, place = ends - sizes, np.repeat(np.arange(len(words)), sizes), np.arange(len(points))
    buckets, owners = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(points), np.uint64)
        for n in range(1, LONGEST + 1):
            h[: len(h) - n + 1] = mix(h[: len(h) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] + np.uint64(1))
            if n >= SHORTEST:
                at = np.flatnonzero((place + n <= ends[owner]) & (sizes[owner] > n))
                buckets.append((h[at] & np.uint64(BUCKETS - 1)).astype(np.int32))
                owners.append(owner[at])
    buckets.append(np.array([crc32(w.encode()) & (BUCKETS - 1) for w in words], dtype=np.int32))
    owners.append(np.arange(len(words)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(buckets)[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])


def shares(first: np.ndarray) -> np.ndarray:
    """The weight of each n-gram in its word's mean."""
    sizes = np.diff(first)
    out = np.repeat(((1 - WORD_SHARE) / np.maximum(sizes - 1, 1)).astype(np.float32), sizes)
    out[first[1:] - 1] = np.where(sizes > 1, WORD_SHARE, 1.0)
    return out


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over neighbouring groups of these sizes, none of them zero."""
    return np.add.reduceat(values, np.cumsum(sizes) - sizes, axis=0)


def _summed_by(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Sums of rows by group number; every group has a row."""
    return sums(values[np.argsort(group, kind="stable")], np.bincount(group, minlength=groups))


def strongest(parts: np.ndarray, first: np.ndarray, k: int = STRONGEST) -> tuple[np.ndarray, np.ndarray]:
    """The places of the k largest parts of each text (all where it has fewer; of equal ones the first), and how many those are."""
    sizes = np.diff(first)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((-parts, owner))
    rank = np.arange(len(parts)) - first[:-1][owner]
    return order[rank < k], np.minimum(sizes, k)


@dataclass
class Toxicity:
    """table: what each bucket adds to the log odds of label 1; bias: what every text has."""

    table: np.ndarray
    bias: float

    def word_parts(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.float32)
        buckets, first = ngrams(words)
        return sums(self.table[buckets] * shares(first), np.diff(first))

    def scores(self, column: pa.Array) -> np.ndarray:
        """The probability of label 1 of each text; a text without words has that of the bias alone."""
        words, at, first = split_words(column)
        parts = self.word_parts(words)[at]
        chosen, sizes = strongest(parts, first)
        total = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=parts[chosen], minlength=len(sizes))
        return 1 / (1 + np.exp(-(total / np.maximum(sizes, 1) + self.bias)))


def train(column: pa.Array, labels: np.ndarray, weights: np.ndarray) -> Toxicity:
    """The model of these texts, labels (0, 1) and weights; without one of the labels it gives every text their share of label 1 (at
    least 1e-6, at most 1 - 1e-6)."""
    if len(np.unique(labels)) < 2:
        share = min(max(float(np.mean(labels)) if len(labels) else 0.0, 1e-6), 1 - 1e-6)
        return Toxicity(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    draw = np.random.default_rng(SEED)
    words, at, first = split_words(column)
    at = at.astype(np.int32)
    buckets, grams = ngrams(words)
    del words
    share, sizes = shares(grams), np.diff(grams)
    table = draw.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) * np.float32(0.01 / DIMENSIONS)
    softmax, bias = draw.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32)
    seen = [np.zeros(BUCKETS, np.float32), np.full(softmax.shape, 1e-8, np.float32), np.full(2, 1e-8, np.float32)]  # squares of steps so far
    rows = np.flatnonzero(np.diff(first) > 0)

    def step(places: np.ndarray, lengths: np.ndarray, y: np.ndarray, w: np.ndarray, rate: float) -> None:
        word, of = np.unique(at[places], return_inverse=True)
        inside, _ = expand(grams[word], sizes[word])
        bucket, gram = np.unique(buckets[inside], return_inverse=True)
        part = share[inside][:, None]
        vectors = sums(table[bucket][gram] * part, sizes[word])
        bags = sums(vectors[of], lengths) / lengths[:, None]
        odds = bags @ softmax + bias
        p = np.exp(odds - odds.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= (w / len(y))[:, None].astype(np.float32)
        to_bags = (p @ softmax.T / lengths[:, None]).astype(np.float32)
        to_words = _summed_by(np.repeat(to_bags, lengths, axis=0), of, len(word))
        to_table = _summed_by(np.repeat(to_words, sizes[word], axis=0) * part, gram, len(bucket))
        seen[0][bucket] += (to_table**2).mean(1)
        table[bucket] -= rate * to_table / (np.sqrt(seen[0][bucket])[:, None] + 1e-8)
        for value, change, square in ((softmax, bags.T @ p, seen[1]), (bias, p.sum(0), seen[2])):
            square += change**2
            value -= (rate * change / np.sqrt(square)).astype(np.float32)

    for n in range(PASSES):
        if n:
            chosen, lengths = strongest(sums((table @ (softmax[:, 1] - softmax[:, 0]))[buckets] * share, sizes)[at], first)
        else:
            chosen, lengths = np.arange(len(at)), np.diff(first)
        start = np.cumsum(lengths) - lengths
        order = draw.permutation(rows)[: None if n else WHOLE]
        batch = BATCH if n else BATCH // 4  # whole texts are long
        for k in range(0, len(order), batch):
            q = order[k : k + batch]
            step(chosen[expand(start[q], lengths[q])[0]], lengths[q], labels[q], weights[q], RATE * (1.01 - n / PASSES))
    return Toxicity((table @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(column: str = "doc_id") -> Column:
    """Whether a row's label is kept from training; a row without doc_id counts as one of an empty doc_id."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN, max_bytes: int = MAX_BYTES) -> Toxicity:
    """The model of a bounded sample of labelled documents that aren't held out.

    labels: doc_id, toxic. Rows with another label than 0 and 1, without doc_id, and doc_ids with both labels are left out;
    repeated labels count once. Each class is weighted back to its share of all usable labels.
    """
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("toxic").alias("label"), F.max("toxic").alias("other")).filter("label = other").select("doc_id", "label")
    totals = dict(usable.groupBy("label").count().collect())
    sample = [r for label, bound in ((1, toxic), (0, clean)) for r in usable.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).collect()]
    ids = docs.sparkSession.createDataFrame([(r[0], r[1]) for r in sample], "doc_id long, label int")
    rows = docs.select("doc_id", "text").filter(F.octet_length("text") <= max_bytes).join(F.broadcast(ids), "doc_id").orderBy("doc_id", F.xxhash64("text")).toArrow()
    found = rows["label"].to_numpy().astype(np.int64)
    taken = np.bincount(found, minlength=2)
    weights = np.array([totals.get(k, 0) / max(1, taken[k]) for k in (0, 1)])
    weights *= taken.sum() / max(1.0, float((weights * taken).sum()))
    return train(rows["text"].combine_chunks() if rows.num_rows else pa.array([], pa.string()), found, weights[found])


def score(docs: DataFrame, model: Toxicity, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with held_out, score (0 to 1) and predicted (1 where the score reaches the threshold).

    Null and empty texts have the score of no words. Equal texts have equal scores. Columns of the three names are replaced,
    others pass through. No shuffle.
    """
    docs = small_batches(docs).drop("held_out", "score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, found = batch.column("text"), [np.zeros(0)]
            sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
            first = 0
            while first < len(column):
                last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + BLOCK_BYTES, side="right")))
                found.append(sent.value.scores(column.slice(first, last - first)))
                first = last
            yield with_columns(batch, {"score": pa.array(np.concatenate(found), pa.float64())})

    scored = docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "score double"]))
    return scored.withColumn("held_out", held_out()).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by the model of the labels that aren't held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, read(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")
