"""Language identification by compression.

For each language, raw text of labelled documents is a zstandard raw-content
dictionary. A text is cut into chunks, each chunk is compressed with each
dictionary, and the language whose dictionary makes the whole text smallest
wins. Chunks keep the dictionary in reach over the whole of a long text.

The model is fitted on a bounded sample: of each language the ``sample_docs``
labelled documents (with some text) whose ids have the smallest hash. Each gives
pieces from all over its text, as many bytes of each document as fit if all of
them are to have a share of ``dict_bytes``. The model is broadcast: at most
``total_bytes``, and if there are more languages than have room in it, their
dictionaries and samples get smaller in proportion; none is dropped.

Null text, or text without a letter: ``und``, score 0. ``rejected`` marks
texts whose margin (the best size below the second best, as a share) is under
``min_margin``; they keep their best guess in ``lang_pred``. Equal sizes: the
language with more labelled documents, then the first by name. Long texts are
compressed whole. Every row gets its own result, equal ones the same; columns
of any name may be there. Without any labelled row all is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.llm._common import LOWER, column_bytes, packed, ship, with_row

_NOT_LETTERS = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+")
_SOME_LETTER = re.compile(r"[^\W\d_]")


def letters(text: bytes) -> bytes:
    """Lower case (of A-Z), all that is ASCII and no letter as one space."""
    return _NOT_LETTERS.sub(b" ", text.translate(LOWER))


PIECES = 4


def pieces(text: Column, chars: int) -> Column:
    """Of a text of over ``chars`` characters, that many from ``PIECES`` places over all of it."""
    each, n = chars // PIECES, F.length(text)
    # where in its quarter a piece starts differs from text to text
    free = F.greatest(F.floor(n / PIECES) - each, F.lit(0)).cast("long")
    start = lambda k: (F.floor(n * k / PIECES) + F.pmod(F.xxhash64(text, F.lit(k)), free + 1) + 1).cast("int")
    return F.when(n <= chars, F.array(text)).otherwise(F.array(*[text.substr(start(k), F.lit(each)) for k in range(PIECES)]))


def share(sizes: list[int], most: int) -> int:
    """The largest s for which the sum of min(size, s) is at most ``most``."""
    left, at = most, len(sizes)
    for x in sorted(sizes):
        if x * at > left:
            return left // at
        left, at = left - x, at - 1
    return max(sizes, default=0)


def fit(labelled: DataFrame, sample_docs: int = 400, dict_bytes: int = 110 << 10, total_bytes: int = 28 << 20) -> dict[str, bytes]:
    """lang -> dictionary, of the rows with a lang and a text; the most frequent language first."""
    rows = labelled.select(
        F.xxhash64(F.col("doc_id").cast("string")).alias("h"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    ).where(F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not counts:
        return {}
    room = min(dict_bytes, max(total_bytes // len(counts), 1))
    docs = max(1, min(sample_docs, sample_docs * room // dict_bytes))
    # hashes are spread evenly: four times as many rows as wanted lie under this bound, and only these are ranked
    limits = labelled.sparkSession.createDataFrame([(x, min((1 << 63) - 1, int((8 * docs / n - 1) * (1 << 63)))) for x, n in counts.items()], "_lang string, bound long")
    chars = max(4 * dict_bytes // sample_docs, 512)
    near = rows.join(F.broadcast(limits), (rows["lang"] == limits["_lang"]) & (rows["h"] <= limits["bound"]))  # a row for each language
    near = near.select("lang", "h", pieces(F.col("text"), chars).alias("parts"))
    sample = near.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h", "parts"))).where(F.col("n") <= docs).orderBy("lang", "n")
    found: dict[str, list[list[bytes]]] = {}
    for r in sample.toLocalIterator():
        found.setdefault(r["lang"], []).append([letters(x.encode()) for x in r["parts"]])
    out = {}
    for lang in sorted(found, key=lambda x: (-counts[x], x)):
        most = share([sum(map(len, x)) + len(x) for x in found[lang]], room)
        cut = lambda x: [p[: most // len(x) - 1] for p in x] if sum(map(len, x)) + len(x) > most else x  # noqa: B023, E731
        out[lang] = b" ".join(p for x in found[lang] for p in cut(x))[:room]
    return out


class Model:
    def __init__(self, dictionaries: dict[str, bytes], chunk: int, level: int):
        self.langs, self.chunk, self.compressors = list(dictionaries), chunk, []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: bytes) -> list[int]:
        parts = [text[i : i + self.chunk] for i in range(0, len(text), self.chunk)]
        return [sum(len(c.compress(p)) for p in parts) for c in self.compressors]

    def predict(self, text: bytes) -> tuple[str, float, float]:
        """(lang, score, margin)"""
        clean = letters(text)
        if not self.langs or not clean.strip() or not _SOME_LETTER.search(text.decode("utf-8", "replace")):
            return "und", 0.0, 0.0
        sizes = self.sizes(clean)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.langs[best], 1.0, 1.0
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = (second - sizes[best]) / max(second, 1)
        return self.langs[best], min(1.0, 0.5 + 5 * margin), margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], keep: list[Column | str] | None = None, min_margin: float = 0.01, chunk: int = 4096, level: int = 5) -> DataFrame:
    """The ``keep`` columns (default doc_id), lang_pred, score (0 to 1, from the margin), margin and rejected of every row's whole text."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(dictionaries)
    rows = packed(docs, keep or ["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(sent.value, chunk, level)
        for b in batches:
            got = [model.predict(x) for x in column_bytes(b, "body")]
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], pa.float64())],
                ["row", "lang_pred", "score", "margin"],
            )

    out = rows.mapInArrow(run, with_row(rows, "lang_pred string, score double, margin double"))
    return out.select("row.*", "lang_pred", "score", "margin", (F.col("margin") < min_margin).alias("rejected"))
