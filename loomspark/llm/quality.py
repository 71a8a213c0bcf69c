"""Quality rules with adaptive thresholds.

Each text gets counts (words, symbols, repeated lines and windows). KLL
sketches of the rates are built for each language and source and merged to
sketches of each language and of the whole table, so no value is sorted or
gathered. A threshold is a fence: the upper quartile plus ``spread`` times the
distance between the quartiles (below: the lower quartile minus that), of the
smallest group that has ``min_group`` documents: language and source, language,
or all. Where a group's quartiles are equal, the distance is that of the next
larger group: between its quartiles, or else its outer tenths. Only where these
are equal in the whole table too it is ``MIN_WIDTH``, so that a table without
any variation doesn't reject all that differs. Thresholds are joined to the
documents by Spark's choice of join (a broadcast only if they are small).

``base_failed``: fewer than 50 words, or over half of the words in 3-word
windows that the text repeats. Documents that base_failed don't enter the
sketches. Null and empty texts have no words and fail. Null languages and
sources are groups like any other. Every row gets its own result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm._common import column_bytes, materialise, packed, ship, with_row

_NOT_SYMBOLS = bytes(b for b in range(256) if chr(b) not in "#*$%&|<>")
_CONTINUED = bytes(range(0x80, 0xC0))
_WORD = re.compile(rb"[^\x20\x09-\x0d]")

RATES = ["word_length", "symbol_rate", "dup_line_rate", "repeat_rate"]
#: rates with a fence on the lower side too
LOWER = {"word_length"}
#: distance where nine tenths of the whole table have one value
MIN_WIDTH = 0.01


def repeat_words(words: list[bytes], n: int = 3) -> int:
    """Words in windows of n words that the text holds twice or more."""
    if len(words) <= n:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    # two steps of pairing keep the numbers exact at any length: a pair's rank is below the number of words
    window = at[: len(at) - n + 1]
    for k in range(1, n):
        both = window * (len(ids) + 1) + at[k : k + len(window)]
        _, window, counts = np.unique(both, return_inverse=True, return_counts=True)
    again = counts[window] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(again), 1)
    np.add.at(cover, np.flatnonzero(again) + n, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def measure(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word)"""
    words = text.split()
    lines = [x for x in text.split(b"\n") if _WORD.search(x)]
    return (
        len(words), sum(map(len, words)) - (0 if text.isascii() else len(text) - len(text.translate(None, _CONTINUED))),
        len(text.translate(None, _NOT_SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words), len(lines),
    )


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns and the counts of every row's whole text."""
    ship(docs.sparkSession)
    rows = packed(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([measure(x) for x in column_bytes(b, "body")], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([b.column("row"), *[pa.array(got[:, i]) for i in range(len(COUNTS))]], ["row", *COUNTS])

    return rows.mapInArrow(run, with_row(rows, ", ".join(f"{c} long" for c in COUNTS))).select("row.*", *COUNTS)


def _rates(out: DataFrame) -> DataFrame:
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return out.withColumns({
        "word_length": per("word_chars", "n_words"), "symbol_rate": per("n_symbols", "word_chars"),
        "dup_line_rate": per("n_dup_lines", "n_lines"), "repeat_rate": per("n_repeat_words", "n_words"),
    })


def _quartiles(sketch: str, rate: str) -> list[Column]:
    """Quartiles, the distance between them and that between the outer tenths; a distance of 0 is null."""
    q = lambda p: F.kll_sketch_get_quantile_double(F.col(sketch), F.lit(p))
    width = lambda p: F.nullif(q(1 - p) - q(p), F.lit(0.0))
    return [q(0.25).alias(f"{rate}_low"), q(0.75).alias(f"{rate}_high"), width(0.25).alias(f"{rate}_width"), width(0.1).alias(f"{rate}_wide")]


def quartiles(measured: DataFrame, min_group: int = 200, k: int = 400) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Quartiles by language and source, by language, and of all, each from merged sketches of the one before."""
    good = measured.where(~F.col("base_failed"))
    first = good.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(F.col(r), F.lit(k)).alias(f"_{r}") for r in RATES])
    first = materialise(first, "sketches")
    merge = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(F.col(f"_{r}"), F.lit(k)).alias(f"_{r}") for r in RATES]]
    shown = lambda df, keys: df.where(F.col("n") >= (min_group if keys else 1)).select(*[F.col(c).alias(f"_k_{c}") for c in keys], *[x for r in RATES for x in _quartiles(f"_{r}", r)])
    return shown(first, ["lang", "source"]), shown(first.groupBy("lang").agg(*merge), ["lang"]), shown(first.groupBy().agg(*merge), [])


def judged(docs: DataFrame, keep: list[str], spread: float = 4.0, min_group: int = 200) -> DataFrame:
    """keep, counts, rates, base_failed, the fences that hold for the row, kept. ``docs`` has lang and source."""
    own = ["lang", "source"]
    named = docs.select(*[F.col(c) for c in dict.fromkeys([*keep, *own])], "text")
    out = _rates(counts(named, [c for c in named.columns if c != "text"]))
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    out = materialise(out, "quality")
    found = [f"{r}_{x}" for r in RATES for x in ("low", "high", "width", "wide")]
    for i, (level, keys) in enumerate(zip(quartiles(out, min_group), (own, ["lang"], []))):  # noqa: B905
        level = level.select(*[f"_k_{c}" for c in keys], *[F.col(f).alias(f"_{i}_{f}") for f in found])
        if keys:
            on = [out[c].eqNullSafe(level[f"_k_{c}"]) for c in keys]
            out = out.join(level, on, "left").drop(*[f"_k_{c}" for c in keys])
        else:
            out = out.join(F.broadcast(level), how="left")  # one row
    fits = ~F.col("base_failed")
    fences = {}
    for r in RATES:
        width = F.coalesce(*[F.col(f"_{i}_{r}_{x}") for i, x in ((0, "width"), (1, "width"), (1, "wide"), (2, "width"), (2, "wide"))], F.lit(MIN_WIDTH))
        low, high = (F.coalesce(*[F.col(f"_{i}_{r}_{x}") for i in range(3)]) for x in ("low", "high"))
        fences[f"{r}_least"] = low - spread * width if r in LOWER else F.lit(None).cast("double")
        fences[f"{r}_most"] = high + spread * width
    out = out.withColumns(fences)
    for r in RATES:
        inside = F.coalesce(F.col(r) <= F.col(f"{r}_most"), F.lit(True)) & F.coalesce(F.col(r) >= F.col(f"{r}_least"), F.lit(True))
        fits = fits & inside
    return out.withColumn("kept", fits).drop(*[f"_{i}_{f}" for i in range(3) for f in found])
