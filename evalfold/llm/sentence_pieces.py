"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and decoding.

A text is cut into chunks that no piece of the vocabulary crosses: a run of spaces with what follows it, up to the next space
or the next character that is only ever a piece by itself. The lattice of a text is the chain of its chunks' lattices, so
filtering runs once for each distinct chunk of a block of texts: alpha(end) = logsumexp over the pieces that end there of
alpha(start) + the piece's log weight. Sampling then walks back from each occurrence's end, choosing a piece with
probability exp(alpha(start) + weight - alpha(end)); its random numbers are hashes of the row's key and the place in the
text, so a row's segmentation is the same in every run and partitioning.

A character without piece becomes its UTF-8 bytes as byte pieces; so does U+2581 itself, which the vocabulary uses for
the space. Decoding joins the pieces' bytes and drops the space put before the text, so every text comes back as it was.

A piece's log weight is -theta * log(2 + rank): the vocabulary file of a BPE model holds ranks, not probabilities. Large
theta leads towards few, frequent pieces.

Everything is one scan; nothing is shuffled and memory is bounded by a block of texts, or by a run of a longer text's chunks
and the pieces that it becomes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalfold.llm.common import read, small_batches
from evalfold.llm.words import mix

THETA = 1.0
#: Characters of texts sampled together.
BLOCK_CHARS = 1 << 19
#: Code that stands for a literal U+2581 inside the lattice; rank that weighs a byte piece.
_LITERAL, _SPACE = 0x110000, 0x2581
_K = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The vocabulary of a piece file as arrays; made once for each worker process."""

    _made: dict[str, Pieces] = {}

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(self.n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(self.n)]
        byte = {int(p[3:5], 16): i for i, p in enumerate(pieces) if sp.is_byte(i)}
        if len(byte) != 256:
            raise ValueError("the vocabulary needs byte pieces")
        self.byte_ids = np.array([byte[b] for b in range(256)], dtype=np.int64)
        text = {i: p for i, p in enumerate(pieces) if not special[i] and not sp.is_byte(i)}
        if any(len(p) > 1 and "▁" in p[1:] and p.strip("▁") for p in text.values()):
            raise ValueError("pieces with a space after their first character aren't handled")
        self.bytes = [b"" if special[i] else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        for b, i in byte.items():
            self.bytes[i] = bytes([b])
        self.longest = max(map(len, text.values()))
        ids = np.array([*text], dtype=np.int64)
        hashes = np.array([_hash(np.array([*map(ord, p)], dtype=np.uint64)) for p in text.values()], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], ids[order]
        # Which hashes may be pieces, and which may end a longer piece: most strings are ruled out by one look.
        self.may_be, self.may_grow = np.zeros(_FLAGS, dtype=bool), np.zeros(_FLAGS, dtype=bool)
        flags, counts = np.unique(_flag(self.hashes), return_counts=True)
        self.may_be[flags] = True
        # The piece of each flag; where several share one, the sorted hashes are searched.
        self.slot = np.zeros(_FLAGS, dtype=np.int32)
        self.slot[_flag(self.hashes)] = np.arange(len(self.hashes))
        self.shared = np.zeros(_FLAGS, dtype=bool)
        self.shared[flags[counts > 1]] = True
        tails = {p[i:] for p in text.values() for i in range(1, len(p))}
        self.may_grow[_flag(np.array([_hash(np.array([*map(ord, p)], dtype=np.uint64)) for p in tails], dtype=np.uint64))] = True
        self.rank = np.array([max(0.0, -sp.get_score(i)) for i in range(self.n)])
        # A chunk is a run of spaces with what follows up to the next space, line end (unless pieces hold it) or U+2581.
        cuts = "▁" if any("\n" in p for p in text.values()) else "\n▁"
        self.chunk = re.compile(f" +[^ {cuts}]*|[^ {cuts}]+|[{cuts}]")
        ends = np.cumsum([0, *map(len, self.bytes)])
        self.starts, self.lengths, self.data = ends[:-1].astype(np.int32), np.diff(ends).astype(np.int32), np.frombuffer(b"".join(self.bytes), np.uint8)

    def weights(self, theta: float) -> tuple[np.ndarray, float]:
        """Log weights of the pieces, and of each byte piece of a character without piece."""
        return -theta * np.log(2.0 + self.rank), -theta * float(np.log(2.0 + self.n))

    def find(self, hashes: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, and those pieces."""
        may = np.flatnonzero(self.may_be[flags])
        at = self.slot[flags[may]]
        again = np.flatnonzero(self.shared[flags[may]])
        at[again] = np.minimum(np.searchsorted(self.hashes, hashes[may[again]]), len(self.hashes) - 1)
        held = self.hashes[at] == hashes[may]
        return may[held], self.ids[at[held]]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts whose pieces are ids[bounds[i]:bounds[i + 1]]: their bytes one after another, and where each starts."""
        start, size = self.starts[ids], self.lengths[ids]
        first = bounds[:-1][bounds[1:] > bounds[:-1]]
        start[first] += 1  # the space put before the text
        size[first] -= 1
        ends = np.append(0, np.cumsum(size))
        out = self.data[np.repeat(start - ends[:-1], size) + np.arange(ends[-1], dtype=np.int32)]
        return out, ends[bounds]


class Numbers(dict):
    """Numbers strings in the order of their first use."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


_FLAGS = 1 << 21


def _flag(hashes: np.ndarray) -> np.ndarray:
    return (((hashes ^ (hashes >> np.uint64(32))) * _K) >> np.uint64(43)).astype(np.int64)


def _hash(codes: np.ndarray) -> np.uint64:
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for c in codes:
            h = h * _K + c + np.uint64(1)
    return h


class Lattice:
    """The filtered lattices of distinct chunks: for each place in a chunk, the pieces that may end there.

    Row r is a place; its choices are at starts[r] to starts[r + 1], with the cumulated probabilities r + (0, 1] in
    `reach`, the piece (vocabulary id, or n + code of a character without piece) and the row that it starts from.
    """

    def __init__(self, chunks: list[str], pieces: Pieces, theta: float) -> None:
        sizes = np.array([len(c) for c in chunks], dtype=np.int64)
        codes = np.frombuffer("".join(chunks).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        codes = np.where(codes == 32, _SPACE, np.where(codes == _SPACE, _LITERAL, codes))
        total = len(codes)
        first = np.cumsum(sizes) - sizes
        place = (np.arange(total) - np.repeat(first, sizes)).astype(np.int32)
        weight, byte_weight = pieces.weights(theta)
        utf8 = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + ((codes > 0xFFFF) & (codes != _LITERAL))
        # Edges by length: the hash of the last n characters of every place, as long as they may end a piece.
        edges = []
        at = np.arange(total, dtype=np.int32)
        h = np.zeros(total, dtype=np.uint64)
        shifted = codes.astype(np.uint64) + np.uint64(1)
        power = 1
        for n in range(1, pieces.longest + 1):
            h = h + shifted[at - n + 1] * np.uint64(power)
            power = power * int(_K) & 0xFFFFFFFFFFFFFFFF
            flags = _flag(h)
            held, found = pieces.find(h, flags)
            if n == 1:
                every = pieces.n + codes
                every[held] = found
                edges.append((n, at, every, np.where(every < pieces.n, weight[np.minimum(every, pieces.n - 1)], byte_weight * utf8)))
            else:
                edges.append((n, at[held], found, weight[found]))
            more = np.flatnonzero(pieces.may_grow[flags])
            more = more[place[at[more]] >= n]
            at, h = at[more], h[more]
            if not len(at):
                break
        # Every place is the end of an edge (of one character at least): lay the edges out by place in the chunk, then by end.
        size = np.zeros(total, dtype=np.int32)
        for _, e, _, _ in edges:
            size[e] += 1
        rows = np.argsort(place, kind="stable").astype(np.int32)
        rank = np.empty(total, dtype=np.int32)
        rank[rows] = np.arange(total, dtype=np.int32)
        first_edge = np.append(0, np.cumsum(size[rows])).astype(np.int32)
        free = first_edge[rank]
        count = int(first_edge[-1])
        start, piece, w = np.empty(count, dtype=np.int32), np.empty(count, dtype=np.int32), np.empty(count)
        inside = np.empty(count, dtype=bool)  # else the piece starts the chunk
        while edges:
            n, e, found, own = edges.pop(0)
            to = free[e]
            free[e] += 1
            start[to], piece[to], w[to], inside[to] = e - n, found, own, place[e] >= n
        # Forward filtering, one place of all chunks at a time.
        alpha = np.zeros(total)
        share = np.empty(count)
        bounds = np.append(0, np.cumsum(np.bincount(place, minlength=1)))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            own = slice(first_edge[a], first_edge[b])
            begin = first_edge[a:b] - first_edge[a]
            score = w[own] + np.where(inside[own], alpha[start[own]], 0.0)
            top = np.maximum.reduceat(score, begin)
            odds = np.exp(score - np.repeat(top, size[rows[a:b]]))
            odds_sum = np.add.reduceat(odds, begin)
            alpha[rows[a:b]] = top + np.log(odds_sum)
            share[own] = odds / np.repeat(odds_sum, size[rows[a:b]])
        # Row r of the choices is place rows[r]; `reach` cumulates from r to r + 1.
        run = np.cumsum(share)
        last = first_edge[1:] - 1
        self.reach = run - np.repeat(run[first_edge[:-1]] - share[first_edge[:-1]], size[rows]) + np.repeat(np.arange(total), size[rows])
        self.reach[last] = np.arange(1.0, total + 1)
        self.piece, self.back = piece, np.where(inside, rank[start], -1)
        self.last = rank[first + sizes - 1]

    def sample(self, chunk: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For occurrences of chunks with a seed each: occurrence and piece of every sampled piece, in text order."""
        who, steps, out = np.argsort(chunk, kind="stable"), [], []  # neighbours look at the same choices
        row, seed = self.last[chunk[who]], seed[who]
        while len(who):
            seed = mix(seed + _K)
            u = (seed >> np.uint64(12)).astype(float) / float(1 << 52)
            at = np.searchsorted(self.reach, row + np.minimum(u, 1 - 2.0**-20), side="right")
            steps.append(who), out.append(self.piece[at])
            row = self.back[at]
            live = row >= 0
            who, row, seed = who[live], row[live], seed[live]
        owner = np.concatenate(steps[::-1])
        order = np.argsort(owner, kind="stable")
        return owner[order], np.concatenate(out[::-1])[order]


def _expand(pieces: Pieces, owner: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters without piece as their byte pieces."""
    bare = np.flatnonzero(found >= pieces.n)
    if not len(bare):
        return owner, found
    codes, which = np.unique(found[bare] - pieces.n, return_inverse=True)
    spelt = [("▁" if c == _LITERAL else chr(c)).encode() for c in codes.tolist()]
    count = np.ones(len(found), dtype=np.int64)
    count[bare] = np.array([len(x) for x in spelt])[which]
    ends = np.cumsum(count)
    out = np.repeat(found, count)
    for nth in range(4):
        has = np.array([len(x) > nth for x in spelt])[which]
        byte = np.array([x[nth] if len(x) > nth else 0 for x in spelt])[which]
        out[(ends - count)[bare[has]] + nth] = pieces.byte_ids[byte[has]]
    return np.repeat(owner, count), out


def encode(texts: list[str], seeds: np.ndarray, pieces: Pieces, theta: float = THETA) -> tuple[np.ndarray, np.ndarray]:
    """Sampled piece ids of all texts one after another, and the bounds of each text's; an empty text has none."""
    numbers = Numbers()
    split, number = pieces.chunk.findall, numbers.__getitem__
    lists = [[*map(number, split(" " + t))] if t else [] for t in texts]
    if not numbers:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    counts = np.array([len(x) for x in lists])
    flat = np.fromiter(chain.from_iterable(lists), np.int32, int(counts.sum()))
    del lists
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
    nth = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
    seed = mix(seeds[doc] + nth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    del nth
    owner, found = _expand(pieces, *Lattice([*numbers], pieces, theta).sample(flat, seed))
    return found, np.searchsorted(doc[owner], np.arange(len(texts) + 1))


def encode_long(text: str, seed: np.ndarray, pieces: Pieces, theta: float = THETA, limit: int = BLOCK_CHARS) -> np.ndarray:
    """The piece ids that `encode` gives one text (seed: its one seed), in runs of chunks of about `limit` characters, so that memory
    follows a run and not the text. Only a single longer chunk is taken whole."""
    out, run, size, done = [np.zeros(0, np.int64)], [], 0, 0

    def sampled() -> np.ndarray:
        numbers = Numbers()
        flat = np.fromiter(map(numbers.__getitem__, run), np.int32, len(run))
        nth = np.arange(done, done + len(run), dtype=np.uint64)
        return _expand(pieces, *Lattice([*numbers], pieces, theta).sample(flat, mix(seed + nth * np.uint64(0xC2B2AE3D27D4EB4F))))[1]

    for m in pieces.chunk.finditer(" " + text if text else ""):
        run.append(m[0])
        size += len(m[0])
        if size >= limit:
            out.append(sampled())
            done, run, size = done + len(run), [], 0
    if run:
        out.append(sampled())
    return np.concatenate(out)


def seeds_of(ids: pa.Array, seed: int) -> np.ndarray:
    """A 64-bit seed of each row's key; a null key is 0."""
    return mix(ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) * _K + np.uint64(seed))


def sample_pieces(docs: DataFrame, path: str, theta: float = THETA, seed: int = 1) -> DataFrame:
    """`docs` with pieces (array of ids), n_pieces, decoded (the text that the pieces spell).

    path: a piece file that every executor can open. A null text is encoded as empty; an empty text has no pieces. Rows
    that repeat a doc_id and text have the same pieces. Existing columns of the new names are replaced.
    """
    docs = small_batches(docs).drop("pieces", "n_pieces", "decoded")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            seeds = seeds_of(batch.column("doc_id"), seed)
            first = 0
            while first < len(texts):
                last, size = first, 0
                while last < len(texts) and (last == first or size + len(texts[last]) <= BLOCK_CHARS):
                    size += len(texts[last])
                    last += 1
                if size > BLOCK_CHARS:
                    ids = encode_long(texts[first], seeds[first : first + 1], pieces, theta)
                    bounds = np.array([0, len(ids)])
                else:
                    ids, bounds = encode(texts[first:last], seeds[first:last], pieces, theta)
                decoded, offsets = pieces.decode(ids, bounds)
                text = pa.LargeStringArray.from_buffers(last - first, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(decoded)).cast(pa.string())
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.slice(first, last - first).columns, lists, pa.array(np.diff(bounds), pa.int64()), text], names=[*names, "pieces", "n_pieces", "decoded"])
                first = last

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "pieces array<int>, n_pieces long, decoded string"]))


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_pieces, pieces_sha256 (of the comma-joined ids), lossless."""
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = sample_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))
    lossless = F.col("decoded") == F.coalesce("text", F.lit(""))
    return found.select("doc_id", "n_pieces", F.sha2(F.array_join("pieces", ",").cast("binary"), 256).alias("pieces_sha256"), lossless.alias("lossless"))
