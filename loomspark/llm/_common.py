"""What the operators of this subpackage share.

Documents are rows with ``doc_id`` and ``text``; operators select those two
(other columns can't clash) and identify a document by its id together with
a hash of its text. Rows equal in both are one document: what is decided for
it holds for each of its rows. A null id is an id of its own, after all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomspark.sources.scratch import hadoop_path, materialise, remove, scratch, shared_dir, ship, written  # noqa: F401  used by the operators

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As LOWER, and ASCII characters other than letters and digits become spaces.
LOWER_ALNUM = bytes(
    b if b >= 128 or chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)

def documents(docs: DataFrame) -> DataFrame:
    """doc_id, text and the hash that tells apart documents of one id."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text")
    )


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text_key as in ``documents``, and row: all columns in a struct, where their names can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def packed(docs: DataFrame, keep: list) -> DataFrame:
    """row (a struct of the kept columns, whatever their names) and body (the text)."""
    return docs.select(F.struct(*keep).alias("row"), F.col("text").cast("string").alias("body"))


def with_row(rows: DataFrame, more: str) -> StructType:
    """The schema of ``row`` and further columns."""
    return StructType([rows.schema["row"], *StructType.fromDDL(more).fields])


def same_document(left: DataFrame, right: DataFrame):
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_key"] == right["text_key"])


def join_counted(rows: DataFrame, keyed: DataFrame, keys: list[str], copies: str) -> DataFrame:
    """Rows with what ``keyed`` (one row a key, of which ``copies`` rows have it) says of their key.

    Keys that more than a thousandth of all rows have, so fewer than a thousand
    keys, are broadcast: their rows never meet in one task. Give tables that are
    written, not plans; both are read more than once.
    """
    often = F.col(copies) * 1000 > rows.count()
    hot, cold = F.broadcast(keyed.where(often)), keyed.where(~often)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(cold, keys))


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column's UTF-8, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """word -> 64-bit hash; forgets all beyond a bound, so that memory doesn't follow the vocabulary."""

    def __init__(self, most: int = 100_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        seq = np.full(size, base, np.uint64)
        seq[0] = 1
        got = _powers[base] = np.multiply.accumulate(seq)
    return got[:n]


def prefix_sums(h: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _power(_BASE_INVERSE, len(h) + 1)[: len(h)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words of each span [start, end), the same wherever the span stands."""
    return mix((sums[end] - sums[start]) * _power(_BASE, len(sums))[start])


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
