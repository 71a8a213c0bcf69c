"""Near copies by similarity: SimHash comparison, and a check of shingles.

Two texts are near copies if their sets of word shingles share ``similarity``
or more of their union. At 0.8 the fingerprints of these sets differ in about
10 to 13 of 64 bits and hardly ever in over 24, a radius at which no block of
their bits tells texts apart. So the blocks to compare are chosen by content
instead: each text has ``BANDS`` keys of ``ROWS`` min-hashes (a pair at 0.8
misses all of them once in a million times). Within a block fingerprints are
compared bit-sliced, which leaves groups of likely copies; a block of more than
``most`` texts is taken as one such group. Within a group fingerprints are
compared again, and links found there are checked on the whole sets of shingles
before they count (``simhash.bucket_links``).

Texts with equal sets are one node, and a set is sent to its group once. A
group of more than ``most`` nodes or ``most_shingles`` shingles is cut into
pieces (``bucket_links`` says how no link is lost).

Lower case is that of A-Z. Fewer words than a shingle: the whole sequence is
the one shingle. Texts without words (null, empty) have equal sets and are
copies of each other. Long texts are read whole; one of more than
``most_shingles`` shingles is a piece of its own kind, of its size. Rows equal in
id and text are one document. Columns of any name are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm._common import column_bytes, documents, identified, join_counted, materialise, mix, same_document, ship
from loomspark.llm.components import components
from loomspark.llm.simhash import EDGE, _compare, bucket_links, majority, shingle_hashes

BANDS, ROWS = 20, 3


def _numbers(n: int, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(2, "little"), seed) | 1 for i in range(n)], np.uint64)


_TURN, _FACTOR, _PLACE = _numbers(BANDS * ROWS, 11), _numbers(BANDS * ROWS, 12), _numbers(ROWS, 13)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """Keys of a set that two sets share with a probability that follows their similarity."""
    if not len(shingles):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        np.minimum(least, ((part[None, :] ^ _TURN[:, None]) * _FACTOR[:, None]).min(1), out=least)
    joined = (mix(least).reshape(BANDS, ROWS) * _PLACE).sum(1, dtype=np.uint64)
    return mix(joined + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def sketches(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """doc_id, text_key, node (digest of the set of shingles), fingerprint, size (of the set), bands of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in column_bytes(b, "text"):
                own = np.unique(shingle_hashes(text, shingle, seed))
                rows.append((xxhash.xxh64_intdigest(own.tobytes(), 1), majority(own), len(own), band_keys(own)))
            node, print_, size, bands = zip(*rows) if rows else ((),) * 4  # noqa: B905
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, print_)], pa.array(size, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "node", "fingerprint", "size", "bands"],
            )

    return documents(docs).mapInArrow(run, "doc_id long, text_key long, node long, fingerprint long, size long, bands array<long>")


def _shingles(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                few = b.slice(at, 512)
                sets = [np.unique(shingle_hashes(x, shingle, seed)).tobytes() for x in column_bytes(few, "text")]
                yield pa.RecordBatch.from_arrays([few.column("node"), few.column("fingerprint"), few.column("bucket"), few.column("cuts"), pa.array(sets, pa.binary())], ["node", "fingerprint", "bucket", "cuts", "shingles"])

    return run


def near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, radius: int = 24, seed: int = 42, most: int = 1024, most_shingles: int = 1 << 20) -> DataFrame:
    """doc_id, text_key, node, component (long: equal for documents that near copies connect) of every row."""
    found = materialise(sketches(docs, shingle, seed), "sketches")
    owner = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    nodes = found.groupBy("node").agg(owner.alias("owner"), F.count(F.lit(1)).alias("copies"), F.min("fingerprint").alias("fingerprint"), F.min("size").alias("size"), F.min("bands").alias("bands"))
    nodes = materialise(nodes, "nodes")
    # links within blocks, by fingerprint alone; only keys that two nodes share go on
    keys = nodes.select("node", "fingerprint", F.explode("bands").alias("bucket"))
    blocks = materialise(keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).where("n > 1"), "blocks")
    shared = materialise(keys.join(blocks, "bucket"), "shared")
    small = shared.where(F.col("n") <= most).select("bucket", "node", "fingerprint", F.lit(0).alias("piece"), F.lit(0).alias("side"), F.col("node").alias("group"))
    small = small.repartition("bucket").sortWithinPartitions("bucket", "piece").mapInArrow(_compare(radius, "node"), EDGE)
    large = shared.where(F.col("n") > most).select(F.col("node").alias("u"), F.col("first").alias("v"))
    likely = components(small.union(large), "u", "v")
    # what they connect, by fingerprint and shingles
    linked = nodes.select("node", "owner", "fingerprint", "size").join(likely, "node").withColumnRenamed("root", "bucket")
    linked = materialise(linked, "likely")
    groups = linked.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("all"))
    cuts = F.greatest(F.ceil(F.col("n") / F.lit(most)), F.ceil(F.col("all") / F.lit(most_shingles)), F.lit(1)).cast("int").alias("cuts")
    wanted = join_counted(linked, materialise(groups, "groups"), ["bucket"], "n").select("owner.doc_id", "owner.text_key", "node", "fingerprint", "bucket", cuts)
    texts = documents(docs)
    once = texts.join(wanted, same_document(texts, wanted)).select("node", "fingerprint", "bucket", "cuts", "text")
    once = once.groupBy("node").agg(*[F.first(c).alias(c) for c in ("fingerprint", "bucket", "cuts", "text")])  # of rows equal in id and text, one
    sets = once.mapInArrow(_shingles(shingle, seed), "node long, fingerprint long, bucket long, cuts int, shingles binary")
    links = bucket_links(materialise(sets, "shingles"), most, radius, "node", similarity)
    named = components(links, "u", "v").withColumnRenamed("node", "_node")
    named = nodes.select("node", "copies").join(named, F.col("node") == F.col("_node"), "left").select("node", "copies", F.coalesce("root", "node").alias("component"))
    return join_counted(found, materialise(named, "components"), ["node"], "copies").select("doc_id", "text_key", "node", "component")


def drop_near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """One document of each component stays, that with the smallest id (null last), and one row of it; columns as they were."""
    found = near_copies(docs, similarity, shingle)
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("text_key").alias("c"))
    keep = found.groupBy("component").agg(F.min(order).alias("k")).select(F.col("k.b").alias("doc_id"), F.col("k.c").alias("text_key"))
    rows = identified(docs)
    return rows.join(keep, same_document(rows, keep)).select(rows["doc_id"], rows["text_key"], "row").dropDuplicates(["doc_id", "text_key"]).select("row.*")
