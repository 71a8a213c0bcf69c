"""Benchmark decontamination by spaced-seed hashing.

A mask such as ``1101011`` hashes the words under its ones and ignores those
under its zeros, so a hit survives replaced words there. The seeds of the
benchmark are joined with those of every place of every document (a hash join
whose build side is the benchmark; a bit table of fixed size answers for most
places). Each hit is verified: along its diagonal, document and item are
compared word by word, and any stretch of ``min_words`` words or more (or of
the item's length, if that is less) with a share of ``min_identity`` equal
words is an overlap. Its ends are those of the best-scoring stretch (match +1,
mismatch ``-mismatch``) if that is one, else of the stretch that exceeds the
share by most words; what is left of the diagonal on either side is searched
again. All overlaps are returned, but of those of one item that share words of
the document only the one with most equal words (of equal ones the first). The
masks hit every stretch of 13 words or more at 0.8,
and of 8, 9, 11 and 12; with replaced words, items of 5, 6, 7 and 10 words can
be missed.

The benchmark is taken in blocks of at most ``block_chars`` characters, by
hash of its rows; each block is broadcast and run against all documents, so
its size bounds every worker's memory however large the benchmark is. The join
of hashes so is a broadcast hash join, done where the hashes are made: shuffling
4 hashes a word would be several times the corpus.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters.
Null and empty texts have no overlap, long ones are searched whole. Items shorter than the shortest mask are
found only by their whole sequence of words. Equal items have a row each. Rows
equal in id and text get equal rows. Columns of any name may be there, and are kept
by ``drop_contaminated``.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm._common import LOWER_ALNUM, WordHashes, column_bytes, documents, identified, mix, same_document, ship

MASKS = ("11111", "1101011", "1010110011", "11001001011")
SCHEMA = "doc_id long, text_key long, item_id long, doc_start int, item_start int, n_words int, n_equal int"


def _offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def _factors(n: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(bytes([i]), 3) | 1 for i in range(n)], np.uint64)


FACTORS = _factors(max(map(len, MASKS)))


def seeds(h: np.ndarray, masks: tuple[str, ...]) -> list[np.ndarray]:
    """Of each mask the hashes at places 0, 1, ..; terms are shared between masks."""
    terms: dict[int, np.ndarray] = {}
    out = []
    for m, mask in enumerate(masks):
        n = len(h) - len(mask) + 1
        if n <= 0:
            out.append(np.empty(0, np.uint64))
            continue
        total = np.full(n, m + 1, np.uint64)
        for j, o in enumerate(_offsets(mask)):
            if j not in terms:
                terms[j] = h * FACTORS[j]
            total += terms[j][o : o + n]
        out.append(mix(total))
    return out


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER_ALNUM).split()


class Index:
    """Seeds of a block of items."""

    def __init__(self, items: list[tuple[int, bytes]], masks: tuple[str, ...]):
        self.masks = masks
        hashes = WordHashes()
        self.items = [(item, hashes.of(words_of(text))) for item, text in items]
        keys, where = [], []
        for i, (_, h) in enumerate(self.items):
            for found in seeds(h, masks):
                keys.append(found)
                where.append(np.stack([np.full(len(found), i), np.arange(len(found))], 1))
        self.keys = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        self.where = (np.concatenate(where) if where else np.empty((0, 2), np.int64))[order]
        bits = min(24, max(16, math.ceil(math.log2(len(self.keys) + 1)) + 4))
        self.mask = np.uint64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, bool)
        self.table[(self.keys & self.mask).astype(np.int64)] = True
        #: items that no mask fits into
        self.short = {}
        for i, (_, h) in enumerate(self.items):
            if 0 < len(h) < min(map(len, masks)):
                self.short.setdefault(len(h), {}).setdefault(h.tobytes(), []).append(i)

    def hits(self, h: np.ndarray) -> list[tuple[int, int]]:
        """(place in the words - place in the item, item's number), each once"""
        n = max(len(self.items), 1)
        out = [np.empty(0, np.int64)]
        for found in seeds(h, self.masks):
            at = np.flatnonzero(self.table[(found & self.mask).astype(np.int64)])
            first = np.searchsorted(self.keys, found[at], "left")
            size = np.searchsorted(self.keys, found[at], "right") - first
            known = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            item, place = self.where[known].T
            out.append(np.unique((np.repeat(at, size) - place) * n + item))
        diagonal, item = np.divmod(np.unique(np.concatenate(out)), n)
        return list(zip(diagonal.tolist(), item.tolist()))  # noqa: B905


def best_stretch(equal: np.ndarray, mismatch: float) -> tuple[int, int]:
    """[start, end) of the stretch with the largest sum of +1 for equal and -mismatch for other places."""
    sums = np.concatenate(([0.0], np.cumsum(np.where(equal, 1.0, -mismatch))))
    low = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - low))
    return int(np.argmin(sums[: end + 1])), end


def similar_stretch(equal: np.ndarray, least: int, identity: float) -> tuple[int, int] | None:
    """[start, end) of the stretch of ``least`` or more places with a share of ``identity`` equal ones that exceeds it most; None if no stretch has it."""
    if len(equal) < least:
        return None
    sums = np.concatenate(([0.0], np.cumsum(equal - identity)))
    low = np.minimum.accumulate(sums[: len(sums) - least])
    over = sums[least:] - low
    k = int(np.argmax(over))
    # the sums' rounding errors are far below the least distance of a share from identity
    return (int(np.argmin(sums[: k + 1])), k + least) if over[k] > -1e-6 else None


def stretches(equal: np.ndarray, least: int, identity: float, mismatch: float) -> list[tuple[int, int]]:
    """[start, end) of all overlaps along a diagonal: the best one, and those of what is left on either side."""
    out, todo = [], [(0, len(equal))]
    while todo:
        low, high = todo.pop()
        if high - low < least:
            continue
        own = equal[low:high]
        a, z = best_stretch(own, mismatch)
        if z - a < least or own[a:z].sum() < identity * (z - a):
            found = similar_stretch(own, least, identity)
            if found is None:
                continue
            a, z = found
        out.append((low + a, low + z))
        todo += [(low, low + a), (low + z, high)]
    return out


def apart(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of (equal words, start in the document, start in the item, words): those with most equal words that share no word of the document, in order."""
    out: list[tuple[int, int, int, int]] = []
    starts: list[int] = []
    for x in sorted(set(found), key=lambda x: (-x[0], *x[1:])):
        i = bisect.bisect(starts, x[1])
        if (i and out[i - 1][1] + out[i - 1][3] > x[1]) or (i < len(out) and out[i][1] < x[1] + x[3]):
            continue
        out.insert(i, x)
        starts.insert(i, x[1])
    return out


def _search(index: Index, min_words: int, min_identity: float, mismatch: float):
    def verified(h: np.ndarray, diagonal: int, item: int) -> Iterator[tuple[int, int, int, int]]:
        words = index.items[item][1]
        s, e = max(0, diagonal), min(len(h), diagonal + len(words))
        equal = h[s:e] == words[s - diagonal : e - diagonal]
        for a, z in stretches(equal, min(min_words, len(words)), min_identity, mismatch):
            yield int(equal[a:z].sum()), s + a, s + a - diagonal, z - a

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in (x.slice(at, 512) for x in batches for at in range(0, max(x.num_rows, 1), 512)):
            texts = [words_of(x) for x in column_bytes(b, "text")]
            h = hashes.of([w for words in texts for w in words])
            ends = np.cumsum([len(x) for x in texts])
            starts = ends - [len(x) for x in texts]
            found: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
            # the batch's words as one sequence; a hit across two texts fails where it is verified
            for diagonal, item in index.hits(h):
                size = len(index.items[item][1])
                for d in range(int(np.searchsorted(ends, max(diagonal, 0), "right")), len(texts)):
                    if starts[d] >= diagonal + size:
                        break
                    if ends[d] > starts[d] and (some := list(verified(h[starts[d] : ends[d]], diagonal - int(starts[d]), item))):
                        found.setdefault((d, item), []).extend(some)
            for size, known in index.short.items():
                for d in range(len(texts)):
                    own = h[starts[d] : ends[d]]
                    for p in range(len(own) - size + 1):
                        for item in known.get(own[p : p + size].tobytes(), ()):
                            found.setdefault((d, item), []).append((size, p, 0, size))
            rows = [(d, index.items[i][0], p, j, n, same) for (d, i), some in sorted(found.items()) for same, p, j, n in apart(some)]
            which = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(which), b.column("text_key").take(which), pa.array([r[1] for r in rows], pa.int64()), *[pa.array([r[c] for r in rows], pa.int32()) for c in range(2, 6)]],
                ["doc_id", "text_key", "item_id", "doc_start", "item_start", "n_words", "n_equal"],
            )

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, min_identity: float = 0.8, mismatch: float = 3.0, masks: tuple[str, ...] = MASKS, block_chars: int = 16 << 20) -> DataFrame:
    """doc_id, text_key, item_id, doc_start, item_start, n_words, n_equal: the overlaps of each document and item."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / (block_chars / 2)))
    rows = documents(docs)
    out = None
    for k in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        index = Index([(r["item_id"], r["text"].encode()) for r in block.orderBy("item_id", "text").toLocalIterator()], masks)
        sent = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            yield from _search(sent.value, min_words, min_identity, mismatch)(batches)

        found = rows.mapInArrow(search, SCHEMA)
        out = found if out is None else out.union(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents that overlap with no item; columns as they were."""
    found = overlaps(docs, benchmark, **options).select("doc_id", "text_key").distinct()
    rows = identified(docs)
    return rows.join(found, same_document(rows, found), "left_anti").select("row.*")
