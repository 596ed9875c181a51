"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

1. One pass over the texts gives each document its number of distinct shingles, a 128-bit hash of the whole set and the
   hashes of its signature's bands. Documents with equal sets form a class; one representative of each goes on, so exact
   copies are never compared, however many there are.
2. Representatives that share a band are candidates. Buckets are never expanded into all pairs. First each member is
   verified against one other: of the leaders of its buckets, the one that it shares most bands with. The verified links
   are grouped, and from then on only buckets whose members still lie in different groups matter. In buckets up to SMALL
   all pairs between groups are verified.
3. The members of larger ones are bucketed again, by the rarest shingles of their sets: of n shingles in order of falling rarity the first
   n - ceil(0.8 n) + 1. Two sets of similarity 0.8 share one of these, while sets that only have a frequent passage in common (which
   is what fills such bands) share none. These buckets go the same way: leaders, groups, small buckets. Members that lie
   outside the largest group of a bucket that is large and open even then meet its other members of fitting size in pairs of
   blocks, inside tasks, so that only links come out. A pair of candidates is left out only when its ends are linked
   through others.
4. Verification counts the shingles that the two full sets share. Sets are made for candidates only: a Bloom filter of
   their ids, of bounded size, is held against the table in a second scan, so texts are never shuffled.

With BANDS bands of ROWS values a pair of similarity 0.8 is missed with probability (1 - 0.8**4)**32, about 5e-8.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalfold.llm.arrow import blocks
from evalfold.llm.bloom import Bloom
from evalfold.llm.common import read, small_batches, staged
from evalfold.llm.components import components
from evalfold.llm.superminhash import band_hashes, signatures
from evalfold.llm.words import Words, mix, word_bytes

BANDS, ROWS = 32, 4
#: Words of a shingle and similarity in percent where nothing else is asked for.
SHINGLE, PERCENT = 5, 80
#: A word is a run of anything but a space, \t, \n, \v, \f and \r.
WORD = word_bytes(lambda c: c != 32 and not 9 <= c <= 13)
BLOCK_BYTES = 1 << 20
#: Members up to which a bucket's pairs between groups are all listed; nodes of a block in larger ones.
SMALL, BLOCK_NODES = 16, 128
#: Bits of the Bloom filter of candidate ids, for each and at most.
ID_BITS, MAX_ID_BITS = 16, 1 << 28
#: Slots of the table that shingles are counted in to tell rare ones from frequent ones.
RARITY = 1 << 18


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted sets of 64-bit shingle hashes of a run of texts, one after another, and their sizes.

    A text of fewer than k words, but not none, has its whole sequence as one shingle.
    """
    w = Words(data, offsets, WORD)
    hashes = w.hashes(np.arange(len(w.starts)))
    counts = np.diff(w.first)
    sets = []
    whole = Words.__new__(Words)
    whole.hashes = hashes.__getitem__
    last = np.arange(k - 1, len(hashes))
    shingles = whole.span_hashes(last, k) if len(last) else np.zeros(0, np.uint64)
    for first, n in zip(w.first[:-1].tolist(), counts.tolist()):
        if n >= k:
            own = np.sort(shingles[first : first + n - k + 1])
            sets.append(own[np.append(True, own[1:] != own[:-1])])
        elif n:
            sets.append(whole.span_hashes(np.array([first + n - 1]), n))
        else:
            sets.append(np.zeros(0, np.uint64))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.array([len(s) for s in sets], dtype=np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def _sign(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in blocks(batch.column("text"), BLOCK_BYTES):
                elements, sizes = shingle_sets(data, offsets, k)
                bands = band_hashes(signatures(elements, sizes, BANDS * ROWS), BANDS)
                ends = np.cumsum(sizes)
                classes = [xxhash.xxh3_128_digest(elements[e - n : e].tobytes()) if n else None for e, n in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(sizes)), pa.array(sizes), pa.array(classes, pa.binary()), _lists(bands.reshape(-1), np.full(len(sizes), BANDS))],
                    names=["doc_id", "n_shingles", "class", "bands"],
                )

    return run


def _candidate_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc_id, shingles) of the documents in `ids`, and of the few others that the filter takes for one of them."""
    sent = docs.sparkSession.sparkContext.broadcast(Bloom.of(ids, "doc_id", ID_BITS, MAX_ID_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(pa.array(sent.value.holds(batch.column("doc_id").to_numpy())))
            for first, data, offsets in blocks(own.column("text"), BLOCK_BYTES):
                elements, sizes = shingle_sets(data, offsets, k)
                yield pa.RecordBatch.from_arrays([own.column("doc_id").slice(first, len(sizes)), _lists(elements, sizes)], names=["doc_id", "shingles"])

    return docs.filter(F.col("doc_id").isNotNull()).mapInArrow(run, "doc_id long, shingles array<long>")


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (mix(shingles.view(np.uint64)) & np.uint64(RARITY - 1)).astype(np.int64)


def _rare_buckets(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(band, node, n, c): each node with the rarest of its shingles that a similar set must share one of, as buckets of c > 1 nodes.

    The order is by how often a shingle's slot occurs among these sets, then by the shingle; any order would lose nothing.
    """
    own = staged(nodes.join(sets.select(F.col("doc_id").alias("node"), "shingles"), "node"), "open-sets")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(RARITY, np.int64)
        for batch in batches:
            times += np.bincount(_slots(batch.column("shingles").flatten().to_numpy()), minlength=RARITY)
        held = np.flatnonzero(times)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(times[held])], names=["slot", "n"])

    table = own.select("shingles").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # RARITY rows at most
    times = np.zeros(RARITY, np.int64)
    times[table["slot"].to_numpy()] = table["n"].to_numpy()
    sent = own.sparkSession.sparkContext.broadcast(times)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("shingles").flatten().to_numpy()
            sizes = batch.column("shingles").value_lengths().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((flat, sent.value[_slots(flat)], owner))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            taken = place < (sizes + (-percent * sizes // 100) + 1)[owner]
            rows = pa.array(owner[taken])
            yield pa.RecordBatch.from_arrays([pa.array(flat[order][taken]), batch.column("node").take(rows), batch.column("n").take(rows)], names=["band", "node", "n"])

    rare = staged(own.select("node", "n", "shingles").mapInArrow(rarest, "band long, node long, n long"), "rare")
    shared = staged(rare.groupBy("band").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "buckets")
    return staged(rare.join(shared, "band"), "members")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """`pairs` (a, b) with `linked`: whether 100 * intersection >= percent * union holds for the full sets."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", (shared * 100 >= (F.size("sa") + F.size("sb") - shared) * percent).alias("linked"))


def _possible(n1: str, n2: str, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough: their similarity is at most the smaller size over the larger."""
    return F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent


def _best(pairs: DataFrame) -> DataFrame:
    """Of (x, y, ...) rows, one for each shared bucket: each x with the y that it shares most buckets with."""
    counted = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("x").agg(F.max(F.struct("n", (-F.col("y")).alias("y"))).alias("best"))
    return best.select("x", (-F.col("best.y")).alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _mixed(rows: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (band, node, n, c) of buckets whose nodes lie in several groups, with `label`; and each such bucket's largest
    group `top`."""
    placed = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = placed.groupBy("band", "label").agg(F.count(F.lit(1)).alias("size"))
    mixed = groups.groupBy("band").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("size", "label")).alias("top")).filter("k > 1")
    mixed = staged(mixed.select("band", F.col("top.label").alias("top")), "mixed")
    return staged(placed.join(mixed.select("band"), "band"), "open"), mixed


def _across(rows: DataFrame, mixed: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) that share a bucket and lie in different groups: each node outside a bucket's largest group
    meets the bucket's nodes of other groups."""
    x = rows.join(mixed, "band").filter(F.col("label") != F.col("top")).select("band", F.col("node").alias("x"), F.col("n").alias("xn"), F.col("label").alias("xl"))
    y = rows.select("band", F.col("node").alias("y"), F.col("n").alias("yn"), F.col("label").alias("yl"))
    pairs = x.join(y, "band").filter(F.col("xl") != F.col("yl")).filter(_possible("xn", "yn", percent))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _links_of(percent: int) -> Callable:
    """Finds, in one pair of blocks, the links between its outside nodes and all its nodes of other groups."""

    def run(table: pa.Table) -> pa.Table:
        outside = table["outside"].to_numpy(zero_copy_only=False)
        nodes, labels = table["node"].to_numpy(), table["label"].to_numpy()
        sets = [np.asarray(x, dtype=np.int64) for x in table["shingles"].combine_chunks().to_numpy(zero_copy_only=False)]
        xs, ys = np.flatnonzero(outside), np.flatnonzero(~outside)
        out: list[tuple[int, int]] = []
        if len(xs) and len(ys):
            sizes = np.array([len(sets[y]) for y in ys])
            values = np.concatenate([sets[y] for y in ys])
            order = np.argsort(values, kind="stable")
            values, owner = values[order], np.repeat(np.arange(len(ys)), sizes)[order]
            for x in xs:
                # The places of x's shingles among all shingles of the other nodes.
                low, high = np.searchsorted(values, sets[x]), np.searchsorted(values, sets[x], side="right")
                n = high - low
                at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                shared = np.bincount(owner[at], minlength=len(ys))
                good = (shared * 100 >= (len(sets[x]) + sizes - shared) * percent) & (labels[ys] != labels[x])
                out += [(min(nodes[x], nodes[y]), max(nodes[x], nodes[y])) for y in ys[good]]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _block_links(rows: DataFrame, mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the large buckets' nodes in different groups, verified in pairs of blocks of about BLOCK_NODES nodes.

    Buckets with the same largest group are taken together. Sizes fall into classes such that similar sets lie in one class or
    in neighbours. The nodes of a class outside the largest group, in blocks, meet all nodes of the three classes, in
    blocks. A row is sent once for each block that it meets, and only links come out, never all pairs.
    """
    size_class = F.floor(F.log(F.col("n")) / float(np.log(100 / percent)) + 1e-9).cast("long") if 0 < percent < 100 else F.col("n")
    nodes = rows.join(mixed, "band").select("top", "node", "label", (F.col("label") != F.col("top")).alias("out"), size_class.alias("own")).distinct()
    nodes = staged(nodes, "block-nodes")
    every = nodes.withColumn("class", F.explode(F.sequence(F.col("own") - 1, F.col("own") + 1)))
    sizes = every.groupBy("top", "class").agg(F.ceil(F.count(F.lit(1)) / BLOCK_NODES).alias("all"), F.ceil(F.count_if(F.col("out") & (F.col("own") == F.col("class"))) / BLOCK_NODES).alias("outs"))
    every = every.join(staged(sizes.filter("outs > 0"), "block-counts"), ["top", "class"])
    block = lambda n: F.pmod(F.xxhash64("node"), n)
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = every.filter(F.col("out") & (F.col("own") == F.col("class"))).select("top", "class", "node", "label", F.lit(True).alias("outside"), block(F.col("outs")).alias("i"), spread(F.col("all")).alias("j"))
    right = every.select("top", "class", "node", "label", F.lit(False).alias("outside"), spread(F.col("outs")).alias("i"), block(F.col("all")).alias("j"))
    dealt = left.unionByName(right).join(sets.select(F.col("doc_id").alias("node"), "shingles"), "node")
    return dealt.groupBy("top", "class", "i", "j").applyInArrow(_links_of(percent), "a long, b long").distinct()


def _more(pairs: DataFrame, done: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """`done` with the pairs that aren't among it yet, verified."""
    new = pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")
    return done.unionByName(staged(_verified(new, sets, percent), "verified"))


def _round(members: DataFrame, done: DataFrame | None, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verifies, among buckets (band, node, n, c), each node against one leader, then all pairs between the groups of small buckets.

    Gives all pairs verified so far, and the rows and largest groups of the buckets that were left open after the leaders.
    """
    # A bucket's leader is its most central member: the one whose buckets are the largest in sum.
    central = staged(members.groupBy("node").agg(F.sum("c").alias("weight")), "central")
    leads = members.join(central, "node").groupBy("band").agg(F.max(F.struct("weight", (-F.col("node")).alias("m"), "n")).alias("l"))
    leads = staged(leads.select("band", F.struct((-F.col("l.m")).alias("node"), F.col("l.n").alias("n")).alias("lead")), "leads")
    star = members.join(leads, "band").filter(F.col("node") != F.col("lead.node")).filter(_possible("n", "lead.n", percent))
    best = _best(star.select(F.col("node").alias("x"), F.col("lead.node").alias("y")))
    done = staged(_verified(best, sets, percent), "verified") if done is None else _more(best, done, sets, percent)
    open_, mixed = _mixed(members.select("band", "node", "n", "c"), components(done.filter("linked")))
    return _more(_across(open_.filter(F.col("c") <= SMALL), mixed, percent), done, sets, percent), open_.filter(F.col("c") > SMALL), mixed


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of `docs` (doc_id, text).

    Two documents are linked when 100 * |intersection| >= percent * |union| of their shingle sets; component_id is the
    least doc_id reachable over links, itself included. A document without words (null, empty, white space) has 0 shingles
    and no link. Rows that share a doc_id are one document. A row without doc_id is compared with nothing: its
    component_id is null and it is kept.
    """
    docs = small_batches(docs).select("doc_id", "text")
    signed = staged(docs.mapInArrow(_sign(k), "doc_id long, n_shingles long, class binary, bands array<long>"), "signatures")
    named = signed.filter(F.col("doc_id").isNotNull() & F.col("class").isNotNull())
    classes = staged(named.groupBy("class").agg(F.min("doc_id").alias("node")), "classes")
    heads = named.join(classes.select(F.col("class").alias("c"), F.col("node").alias("doc_id")), "doc_id").filter(F.col("class") == F.col("c"))
    banded = heads.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    shared = staged(banded.groupBy("band").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "buckets")
    members = staged(banded.join(shared, "band"), "members")
    sets = staged(_candidate_sets(docs, members.select(F.col("node").alias("doc_id")).distinct(), k), "shingle-sets")
    done, large, mixed = _round(members, None, sets, percent)
    links = done.filter("linked").select("a", "b")
    if not large.isEmpty():
        done, large, mixed = _round(_rare_buckets(large.select("node", "n").distinct(), sets, percent), done, sets, percent)
        links = done.filter("linked").select("a", "b").unionByName(_block_links(large, mixed, sets, percent))
    labels = components(links)

    placed = signed.select("doc_id", "n_shingles", "class").join(classes, "class", "left")
    placed = placed.join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("label", "node", "doc_id").alias("component_id"))
    placed = placed.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return placed.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by distinct 2-word shingles and similarity 0.8."""
    return near_duplicates(read(spark, sf_dir, "documents"), k=2)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
t AS (SELECT s.doc_id, n, shingle FROM s JOIN n USING (doc_id)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM t a JOIN t b
      ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a)
SELECT doc_id, any_value(coalesce(n, 0)) AS n_shingles, min(reach) AS component_id, doc_id = min(reach) AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
