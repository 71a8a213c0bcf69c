"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: the majority, bit by bit, of the XXH64 of all word shingles.
Candidates are exact: with ``radius`` r, two fingerprints that differ in at
most r of 64 bits agree in one of r + 1 blocks of bits. Within a block's
bucket, bit planes are stored vertically (word i of plane b holds bit b of 64
fingerprints); one XOR and a carry-save counter of three planes update 64
distances at a time, and a block of queries is abandoned as soon as all of its
distances exceed the radius.

Equal fingerprints are one node. A bucket with more than ``most`` fingerprints
is dealt out again by the same argument over its other bits. One that is still
too large is cut into pieces, twice and differently (``bucket_links``); only
what its largest group of linked nodes leaves over is then compared with all
of it. Nothing is dropped, and rows are sent around in proportion to the bucket
unless that rest is large. A bucket yields a spanning forest of its links, not
all pairs.

Empty or null text, or text without words: fingerprint zero, linked like any
other. Fewer words than a shingle: the whole sequence is the one shingle. Long
texts are read whole; their hashes are counted in parts. Rows equal in id and
text get equal rows; other columns aren't read, so their names can't clash. No
rows: no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm._common import LOWER, column_bytes, documents, join_counted, materialise, ship
from loomspark.llm.components import components

BITS = 64


def shingle_hashes(text: bytes, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, "<u8")
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        line = b" ".join(words)
        ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
        starts = [0, *[e + 1 for e in ends[: len(words) - shingle]]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :])]  # noqa: B905  as many of each
    return np.array(hashes, "<u8")


def majority(h: np.ndarray) -> int:
    """The fingerprint: bit by bit, what over half of the hashes have."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 15):
        counts += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = 5, seed: int = 42) -> DataFrame:
    """doc_id, text_key, fingerprint (long, its bits as they are) of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(x, shingle, seed) for x in column_bytes(b, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(got)], ["doc_id", "text_key", "fingerprint"])

    return documents(docs).mapInArrow(run, "doc_id long, text_key long, fingerprint long")


# -- bit-sliced comparison ------------------------------------------------------------------------


def planes_of(prints: np.ndarray) -> np.ndarray:
    """uint64[64, words]: bit j of word i of plane b is bit b of fingerprint 64 i + j."""
    n = len(prints)
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8), bitorder="little").reshape(n, BITS)
    padded = np.zeros((-(-n // 64) * 64, BITS), np.uint8)
    padded[:n] = bits
    return np.packbits(padded.T.copy(), axis=1, bitorder="little").view("<u8")


def near_rows(queries: np.ndarray, prints: np.ndarray, radius: int, upper: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """Of each query that has any: its index, and the indexes of the prints that differ in at most ``radius`` bits; upper: only print > query, of one array.

    A query is abandoned once all of its distances exceed the radius; the ones that are left close up.
    """
    n, words = len(prints), -(-len(prints) // 64)
    if not n or not len(queries):
        return
    planes = planes_of(prints)
    step = max(1, (1 << 16) // words)
    live = np.zeros(words * 64, np.uint8)
    live[:n] = 1
    valid = np.packbits(live, bitorder="little").view("<u8")
    limit = radius + 1
    ones = ~np.uint64(0)
    for at in range(0, len(queries), step):
        q = queries[at : at + step]
        which = np.arange(len(q))
        over = np.repeat(~valid[None, :], len(q), 0)
        if upper:
            column = np.arange(words * 64)[None, :]
            over |= np.packbits((column <= np.arange(at, at + len(q))[:, None]).astype(np.uint8), axis=1, bitorder="little").view("<u8")
        counter = [np.zeros_like(over) for _ in range(limit.bit_length())]
        for b in range(BITS):
            bit = np.where((q >> np.uint64(b)) & np.uint64(1), ones, np.uint64(0))[:, None]
            x = planes[b][None, :] ^ bit
            x &= ~over
            for i, c in enumerate(counter):
                carry = c & x if i + 1 < len(counter) else None
                c ^= x
                x = carry
            # a counter that has reached radius + 1 stays over
            reached = None
            for i, c in enumerate(counter):
                digit = c if limit >> i & 1 else ~c
                reached = digit if reached is None else reached & digit
            over |= reached
            if b >= radius and b % 4 == 3:
                alive = (over != ones).any(1)
                if not alive.any():
                    break
                if 2 * alive.sum() < len(q):
                    q, which, over, counter = q[alive], which[alive], over[alive], [c[alive] for c in counter]
        else:
            near = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")
            for i in np.flatnonzero(near.any(1)).tolist():
                yield at + int(which[i]), np.flatnonzero(near[i])


def links(queries: np.ndarray, prints: np.ndarray, radius: int, upper: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs (query, print) of ``near_rows``."""
    found = [np.stack([np.full(len(j), i), j]) for i, j in near_rows(queries, prints, radius, upper)]
    both = np.concatenate([np.empty((2, 0), np.int64), *found], axis=1)
    return both[0], both[1]


def forest(near: Iterator[tuple[int, np.ndarray]], prints: np.ndarray, holds: Callable[[int, int], bool] | None = None, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Of the links between nodes (those that hold), as many as connect what all of them connect; a node's neighbours are never more than one row of indexes.

    With a check, the closest fingerprints come first, and nodes that are connected already (from the start: those of one ``group``) aren't checked.
    """
    group = np.arange(len(prints)) if group is None else np.unique(group, return_inverse=True)[1]
    kept = []
    for x, others in near:
        others = others[group[others] != group[x]]
        if holds is not None and len(others) > 1:
            others = others[np.argsort(np.bitwise_count(prints[others] ^ prints[x]), kind="stable")]
        while len(others):
            y = int(others[0])
            others = others[1:]
            if holds is None or holds(x, y):
                group[group == group[y]] = group[x]
                others = others[group[others] != group[x]]
                kept.append((x, y))
    return kept


def _blocks(width: int, parts: int, first: int = 0) -> list[tuple[int, int]]:
    """(first bit, bits) of ``parts`` nearly equal blocks."""
    edges = [width * i // parts for i in range(parts + 1)]
    return [(first + a, b - a) for a, b in zip(edges, edges[1:])]  # noqa: B905


def _bits(value: Column, first: int, n: int) -> Column:
    return F.shiftrightunsigned(value, first).bitwiseAND(F.lit((1 << n) - 1)) if n else F.lit(0).cast("long")


def _compare(radius: int, node: str, similarity: float | None = None):
    """Runs of rows with equal bucket and piece, one after the other. Rows of side 1 are compared with those of side 0; without any, all with all.

    group: nodes known to be connected. similarity: links must also have that share of equal ``shingles``, closest fingerprints first.
    """

    def emit(rows: list[tuple]) -> list[tuple[int, int]]:
        prints = np.concatenate([r[0] for r in rows]).view(np.uint64)
        side, name, group = (np.concatenate([r[c] for r in rows]) for c in (1, 2, 3))
        if len(prints) < 2:
            return []
        if side.any():
            one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            near = ((int(two[i]), one[j]) for i, j in near_rows(prints[two], prints[one], radius))
        else:
            near = near_rows(prints, prints, radius, upper=True)
        holds = None
        if similarity is not None:
            sets = [np.frombuffer(x, "<u8") for r in rows for x in r[4]]

            def holds(x: int, y: int) -> bool:
                one, two = sets[x], sets[y]
                if min(len(one), len(two)) < similarity * max(len(one), len(two)):
                    return False
                both = np.sort(np.concatenate((one, two)), kind="stable")
                equal = int((both[1:] == both[:-1]).sum())
                return equal >= similarity * (len(both) - equal)

        return [(int(name[x]), int(name[y])) for x, y in forest(near, prints, holds, group)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "piece")], 1)
            prints, side, name, group = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fingerprint", "side", node, "group"))
            sets = batch.column("shingles").to_pylist() if similarity is not None else []
            if not len(keys):
                continue
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            out = []
            for s, e in zip(cuts, cuts[1:]):  # noqa: B905
                now = tuple(keys[s].tolist())
                if held and now != bucket:
                    out += emit(held)
                    held = []
                bucket = now
                held.append((prints[s:e], side[s:e], name[s:e], group[s:e], sets[s:e]))
            yield _edges(out)
        yield _edges(emit(held) if held else [])

    def _edges(out: list[tuple[int, int]]) -> pa.RecordBatch:
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    return run


EDGE = "u long, v long"


def bucket_links(rows: DataFrame, most: int, radius: int, node: str = "fingerprint", similarity: float | None = None) -> DataFrame:
    """u, v: links between the nodes of each bucket that connect exactly what all of its links within the radius connect.

    ``rows`` (written): node, fingerprint, bucket, cuts (the number of pieces that a bucket needs), and shingles if there is a similarity. A bucket of one
    piece is compared at once. A larger one is cut by two different hashes, each piece on its own. What is connected then needs no comparison any more:
    the nodes outside of the bucket's largest group, ``most`` at a time, are compared with all of its pieces.
    """
    columns = ["bucket", "fingerprint", *([node] if node != "fingerprint" else []), *(["shingles"] if similarity is not None else [])]
    found = _compare(radius, node, similarity)

    def compared(pieces: DataFrame, more: list[str] = ["piece", "side", "group"]) -> DataFrame:  # noqa: B006
        return pieces.select(*columns, *more).repartition("bucket", "piece").sortWithinPartitions("bucket", "piece").mapInArrow(found, EDGE)

    spark = rows.sparkSession
    piece = lambda salt, n: F.pmod(F.xxhash64(node, F.lit(salt)), n.cast("long"))
    plain = {"side": F.lit(0), "group": F.col(node)}
    whole = compared(rows.where("cuts = 1").withColumns({"piece": F.lit(0).cast("long"), **plain}))
    cut = rows.where("cuts > 1")
    if cut.isEmpty():
        return whole
    once = materialise(compared(cut.withColumns({"piece": piece(1, F.col("cuts")), **plain})), "links")
    again = materialise(compared(cut.withColumns({"piece": piece(2, F.col("cuts")), **plain})), "links")
    known = once.union(again)
    named = components(known, "u", "v").withColumnRenamed("node", "_node")
    held = cut.join(named, F.col(node) == F.col("_node"), "left").withColumn("group", F.coalesce("root", node)).drop("_node", "root")
    held = materialise(held, "groups")
    sizes = held.groupBy("bucket", "group").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "group")).alias("m"), F.sum("n").alias("all"))
    main = materialise(main.select("bucket", F.col("m.group").alias("main"), F.col("all").alias("n"), F.ceil((F.col("all") - F.col("m.n")) / F.lit(most)).cast("int").alias("parts")), "largest")
    held = join_counted(held, main, ["bucket"], "n").where("parts > 0")
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    at = lambda a, b: (a * F.lit(1 << 31) + b).alias("piece")
    members = held.withColumn("own", piece(1, F.col("cuts"))).select("*", number("parts").alias("part")).select(*columns, "group", at(F.col("own"), F.col("part")), F.lit(0).alias("side"))
    rest = held.where(F.col("group") != F.col("main")).withColumn("part", piece(3, F.col("parts"))).select("*", number("cuts").alias("own")).select(*columns, "group", at(F.col("own"), F.col("part")), F.lit(1).alias("side"))
    left = compared(members.unionByName(rest))
    return whole.union(known).union(left)


def print_links(prints: DataFrame, radius: int = 4, most: int = 4096) -> DataFrame:
    """u, v: links between distinct fingerprints that connect exactly what all links within the radius connect."""
    ship(prints.sparkSession)
    parts = radius + 1
    value = F.col("fingerprint")
    level1 = prints.select(
        "fingerprint",
        F.explode(F.array(*[F.struct(F.lit(t).alias("t"), _bits(value, a, n).alias("key")) for t, (a, n) in enumerate(_blocks(BITS, parts))])).alias("b"),
    ).select("fingerprint", F.col("b.t").alias("t"), F.xxhash64("b.t", "b.key").alias("bucket"))
    counted = lambda rows: materialise(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    # both sides of these joins are read as written, so that Spark can split a skewed bucket
    level1 = materialise(level1, "level")
    level1 = level1.join(counted(level1), "bucket")
    # a large bucket: its other bits, which hold all differences, are cut into blocks in their turn
    rest = F.lit(None)
    for t, (a, n) in enumerate(_blocks(BITS, parts)):
        low = _bits(value, 0, a)
        high = F.shiftleft(F.shiftrightunsigned(value, a + n), a) if a + n < BITS else F.lit(0).cast("long")
        packed, width = low.bitwiseOR(high), BITS - n
        again = F.array(*[F.struct(F.lit(u).alias("u"), _bits(packed, f, m).alias("key")) for u, (f, m) in enumerate(_blocks(width, parts))])
        rest = F.when(F.col("t") == t, again).otherwise(rest) if t else F.when(F.col("t") == t, again)
    fine = level1.where(F.col("n") <= most).select("fingerprint", "bucket")
    level2 = level1.where(F.col("n") > most).select("fingerprint", "bucket", F.explode(rest).alias("c"))
    level2 = level2.select("fingerprint", F.xxhash64("bucket", "c.u", "c.key").alias("bucket"))
    rows = materialise(fine.union(level2), "level")
    rows = rows.join(counted(rows), "bucket").select("fingerprint", "bucket", F.ceil(F.col("n") / F.lit(most)).cast("int").alias("cuts"))
    return bucket_links(materialise(rows, "buckets"), most, radius)


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, text_key, fingerprint (long), component_id (smallest doc_id that links lead to, null only if all of them are), component (long)."""
    prints = materialise(fingerprints(docs, shingle, seed), "simhash")
    nodes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    found = components(print_links(nodes.select("fingerprint"), radius), "u", "v")
    linked = materialise(nodes.join(found, nodes["fingerprint"] == found["node"]).select("fingerprint", "root", "least"), "linked")
    least = linked.groupBy("root").agg(F.min("least").alias("all_least"), F.count(F.lit(1)).alias("members"))
    named = join_counted(linked, least, ["root"], "members").select(F.col("fingerprint").alias("_f"), F.col("root"), F.col("all_least"))
    alone = nodes.select(F.col("fingerprint").alias("_n"), "least", "copies")
    named = alone.join(named, F.col("_n") == F.col("_f"), "left").select(
        F.col("_n").alias("fingerprint"), "copies", F.coalesce("root", "_n").alias("component"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("all_least")).alias("component_id")
    )
    named = join_counted(prints, materialise(named, "components"), ["fingerprint"], "copies")
    return named.select("doc_id", "text_key", "fingerprint", "component_id", "component")
