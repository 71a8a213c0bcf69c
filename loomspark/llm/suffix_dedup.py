"""Passages that occur more than once, by sparse suffix arrays.

A text is its white-space separated words, as they are. Suffixes are retained
only where they start with the minimiser of a window, chosen by content: of
the k-word hashes at ``w = min_words - k + 1`` consecutive places the smallest,
leftmost if equal. Every passage of ``min_words`` words so has one retained
suffix that any other copy of the passage retains too.

Sorting: suffixes are sorted by the digest of their first k words, then of their
context (the words from the first to the last passage that the suffix stands
for), then by document and place, so the suffixes of a very common passage are
spread over many ranges. In each range neighbours are compared: a suffix that
agrees with neither of them in its first k words has no partner; the others are
told by run, a row for each context and range. Runs are summed up over ranges.

Extending: a run whose first and last context are equal consists of copies
throughout. In any other run each distinct context is extended, word by word, to
the left and right of the minimiser, and each extension that covers
``min_words`` words is compared with the others, as those that agree to the left
too need not be next to each other. Digests have 64 bits, two of them always have
to agree. What a run or passage is known to be is joined back by count
(``join_counted``), so a passage that a third of the corpus holds never lands in
one task, and copies of a context are one row before anything is extended.

The result is exact: a word is repeated if it lies in ``min_words`` words that
occur at two places or more (of one document or of several). The first
occurrence is that of the smallest doc_id (null last), then place; words of
the others are to be removed, but for words that a first occurrence needs (of
a text that repeats itself). Null, empty or shorter texts have no passage.
Rows equal in id and text repeat each other, and neither is removed for that.
Long texts are read whole. Columns of any name may be there, and are kept by
``drop_repeated_passages``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm._common import WordHashes, column_bytes, documents, identified, join_counted, materialise, mix, prefix_sums, same_document, ship, span_hashes, with_row

SPANS = "array<struct<start:int,end:int>>"


def minimisers(h: np.ndarray, min_words: int, k: int) -> tuple[np.ndarray, ...]:
    """Prefix sums, k-word hashes, and of each retained suffix: its place, the first and the last passage start that it stands for."""
    sums = prefix_sums(h)
    at = np.arange(len(h) - k + 1)
    grams = span_hashes(sums, at, at + k)
    windows = np.lib.stride_tricks.sliding_window_view(grams, min_words - k + 1)
    place = windows.argmin(1) + np.arange(len(windows))
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:] - 1, [len(place) - 1]))
    return sums, grams, place[first], first, last


def suffixes(docs: DataFrame, min_words: int, k: int) -> DataFrame:
    """A row for each retained suffix: prefix (digest of k words), context (digest), place, lo, hi."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            out, rows = [], []
            for i, text in enumerate(column_bytes(b, "text")):
                words = text.split()
                if len(words) < min_words:
                    continue
                sums, grams, place, lo, hi = minimisers(hashes.of(words), min_words, k)
                context = mix(span_hashes(sums, lo, hi + min_words) ^ ((place - lo) * 4096 + (hi - lo)).astype(np.uint64))
                out.append((grams[place].view(np.int64), context.view(np.int64), place, lo, hi))
                rows.append(np.full(len(place), i))
            if rows:
                which = pa.array(np.concatenate(rows))
                columns = [np.concatenate(x) for x in zip(*out)]  # noqa: B905
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(which), b.column("text_key").take(which), pa.array(columns[0]), pa.array(columns[1]), *[pa.array(c.astype(np.int32)) for c in columns[2:]]],
                    ["doc_id", "text_key", "prefix", "context", "place", "lo", "hi"],
                )

    return documents(docs).mapInArrow(run, "doc_id long, text_key long, prefix long, context long, place int, lo int, hi int")


def _order(place: str):
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("text_key").alias("text_key"), F.col(place).alias("at"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted suffixes a row for each prefix and context, with its first suffix and how many there are; without those that no neighbour agrees with in the prefix."""
    held: pa.Table | None = None  # the last context so far, which may go on
    before: int | None = None  # the prefix of the context before it
    for b in batches:
        if not b.num_rows:
            continue
        prefix, context = (b.column(c).to_numpy(zero_copy_only=False) for c in ("prefix", "context"))
        cut = np.flatnonzero(np.concatenate(([True], (prefix[1:] != prefix[:-1]) | (context[1:] != context[:-1]))))
        copies = np.diff(np.append(cut, len(prefix)))
        found = pa.Table.from_batches([b]).take(pa.array(cut)).append_column("copies", pa.array(copies))
        edge = held is None
        if held is not None:
            if all(held.column(c)[0] == found.column(c)[0] for c in ("prefix", "context")):
                copies = copies.copy()
                copies[0] += held.column("copies")[0].as_py()
                found = pa.concat_tables([held, found.slice(1)]).set_column(found.num_columns - 1, "copies", pa.array(copies))
            else:
                found = pa.concat_tables([held, found])
        prefix, copies = (found.column(c).to_numpy() for c in ("prefix", "copies"))
        same = prefix[1:] == prefix[:-1]
        keep = copies > 1
        keep[1:] |= same
        keep[:-1] |= same
        # ends of a range may have partners in the next one
        keep[0] |= edge or before == prefix[0]
        held = found.slice(found.num_rows - 1)
        before = int(prefix[-2]) if len(prefix) > 1 else before
        told = found.slice(0, found.num_rows - 1).filter(pa.array(keep[:-1]))
        yield from told.to_batches()
    if held is not None:
        yield from held.to_batches()


def runs_of(found: DataFrame) -> DataFrame:
    """prefix, copies, low and high (contexts), first (suffix) of the runs of two suffixes or more."""
    order = ["prefix", "context", "no_id", "doc_id", "text_key", "place"]
    rows = found.select("prefix", "context", F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "place")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    told = rows.mapInArrow(_runs, "prefix long, context long, no_id boolean, doc_id long, text_key long, place int, copies long")
    runs = told.groupBy("prefix").agg(F.sum("copies").alias("copies"), F.min("context").alias("low"), F.max("context").alias("high"), F.min(_order("place")).alias("first"))
    return runs.where("copies > 1")


def _extend(min_words: int):
    """For the contexts (place, lo, hi) of a text, a row for each extension that covers min_words words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            out, rows = [], []
            for i, (text, want) in enumerate(zip(column_bytes(b, "text"), b.column("want").to_pylist())):  # noqa: B905
                sums = prefix_sums(hashes.of(text.split()))
                lo, hi = (np.array([x[c] for x in want], np.int64) for c in ("lo", "hi"))
                size = hi - lo + 1
                start = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                out.append([np.repeat(np.array([x[c] for x in want], np.int64), size) for c in ("prefix", "context", "copies", "place")] + [start, span_hashes(sums, start, start + min_words).view(np.int64)])
                rows.append(np.full(len(start), i))
            if rows:
                which = pa.array(np.concatenate(rows))
                prefix, context, copies, place, start, passage = (np.concatenate(x) for x in zip(*out))  # noqa: B905
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(which), b.column("text_key").take(which), *map(pa.array, (prefix, context, copies, (place - start).astype(np.int32), start.astype(np.int32), passage))],
                    ["doc_id", "text_key", "prefix", "context", "copies", "back", "start", "passage"],
                )

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def minus(spans: list[tuple[int, int]], kept: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Both in order and merged."""
    out = []
    for s, e in spans:
        for a, b in kept:
            if a < e and b > s:
                if s < a:
                    out.append((s, a))
                s = max(s, b)
        if s < e:
            out.append((s, e))
    return out


def _spans(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(found: list[dict], mask) -> list[tuple[int, int]]:
            spans = []
            for x in found:
                bits = mask(x)
                while bits:
                    low = (bits & -bits).bit_length() - 1
                    run = ((~(bits >> low)) & -(~(bits >> low))).bit_length() - 1  # ones in a row
                    # offset back = place - start: the highest offset is the leftmost start
                    spans.append((x["place"] - low - run + 1, x["place"] - low + min_words))
                    bits &= ~(((1 << run) - 1) << low)
            return merged(spans)

        def shown(spans: list[tuple[int, int]]) -> list[dict]:
            return [{"start": s, "end": e} for s, e in spans]

        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            found = b.column("found").to_pylist()
            again = [of(x, lambda y: y["again"]) for x in found]
            removed = [minus(of(x, lambda y: y["later"]), of(x, lambda y: y["again"] & ~y["later"])) for x in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(map(shown, again), kind), pa.array(map(shown, removed), kind)],
                ["doc_id", "text_key", "repeated", "removed"],
            )

    return run


def repeated_passages(docs: DataFrame, min_words: int = 50, k: int = 20) -> DataFrame:
    """doc_id, text_key, repeated, removed: of each document with repeated passages, the word spans [start, end) of all of them and of those that aren't the first occurrence."""
    if not 1 <= k <= min_words or min_words - k + 1 > 62:
        raise ValueError("k: 1 to min_words, and min_words - k at most 61")
    found = materialise(suffixes(docs, min_words, k), "suffixes")
    runs = materialise(runs_of(found).select("prefix", "copies", (F.col("low") == F.col("high")).alias("same"), "first"), "runs")
    shared = materialise(join_counted(found, runs, ["prefix"], "copies").drop("copies"), "shared")
    shifted = lambda x, by: F.call_function("shiftleft", x, by)
    one = F.lit(1).cast("long")
    offsets = lambda: shifted(shifted(one, F.col("hi") - F.col("lo") + 1) - 1, F.col("place") - F.col("hi"))
    whole = shared.where("same").select(
        "doc_id", "text_key", "place", offsets().alias("again"), F.when(_order("place") == F.col("first"), F.lit(0).cast("long")).otherwise(offsets()).alias("later")
    )
    # runs of several contexts: each context once, extended to the left and right
    mixed = shared.where("not same").drop("same", "first")
    contexts = mixed.groupBy("prefix", "context").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(_order("place").alias("o"), F.col("lo"), F.col("hi"))).alias("m"))
    wanted = contexts.select(
        F.col("m.o.doc_id").alias("doc_id"), F.col("m.o.text_key").alias("text_key"),
        F.struct("prefix", "context", "copies", F.col("m.o.at").alias("place"), F.col("m.lo").alias("lo"), F.col("m.hi").alias("hi")).alias("want"),
    ).groupBy("doc_id", "text_key").agg(F.collect_list("want").alias("want"))
    texts = documents(docs)
    once = texts.join(wanted, same_document(texts, wanted)).select(texts["doc_id"], texts["text_key"], "text", "want")
    extended = once.mapInArrow(
        _extend(min_words), "doc_id long, text_key long, prefix long, context long, copies long, back int, start int, passage long"
    )
    extended = materialise(extended, "extended")
    passages = extended.groupBy("prefix", "passage", "back").agg(F.sum("copies").alias("places"), F.count(F.lit(1)).alias("rows"), F.min(_order("start")).alias("first"))
    passages = materialise(passages.where("places > 1").drop("places"), "passages")
    again = join_counted(extended, passages, ["prefix", "passage", "back"], "rows")
    bit = shifted(one, F.col("back"))
    masks = again.groupBy("prefix", "context").agg(
        F.bit_or(bit).alias("again"), F.bit_or(F.when(_order("start") == F.col("first"), F.lit(0).cast("long")).otherwise(bit)).alias("later")
    )
    first = contexts.select("prefix", "context", F.col("copies").alias("rows"), F.col("m.o").alias("owner"))
    masks = materialise(masks.join(first, ["prefix", "context"]), "masks")
    partly = join_counted(mixed, masks, ["prefix", "context"], "rows").select(
        "doc_id", "text_key", "place", "again", F.when(_order("place") == F.col("owner"), F.col("later")).otherwise(F.col("again")).alias("later")
    )
    each = whole.union(partly).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("place", "again", "later")).alias("found"))
    return each.mapInArrow(_spans(min_words), f"doc_id long, text_key long, repeated {SPANS}, removed {SPANS}")


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without these words; white space goes with the word before it."""
    import re

    starts = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0d]+", text)] + [len(text)]
    out, at = [], 0
    for s, e in spans:
        out.append(text[at : starts[s]])
        at = starts[e]
    return b"".join([*out, text[at:]])


def drop_repeated_passages(docs: DataFrame, min_words: int = 50, k: int = 20) -> DataFrame:
    """Documents without the later occurrences of passages; a document of which no word is left goes. n_chars, if there, follows the text."""
    found = repeated_passages(docs, min_words, k).where(F.size("removed") > 0).select("doc_id", "text_key", "removed")
    rows = identified(docs)
    rows = rows.join(found, same_document(rows, found), "left").select("row", F.col("row.text").cast("string").alias("body"), "removed")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep = b.column("body").cast(pa.binary()).to_pylist(), np.ones(b.num_rows, bool)
            for i, removed in enumerate(b.column("removed").to_pylist()):
                if removed:
                    texts[i] = without_spans(texts[i], [(x["start"], x["end"]) for x in removed])
                    keep[i] = bool(texts[i].split())
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.binary()).cast(pa.string())], ["row", "body"]).filter(pa.array(keep))

    out = rows.mapInArrow(cut, with_row(rows, "body string"))
    return out.select(*[
        F.col("body").cast(f.dataType).alias(f.name) if f.name == "text"
        else F.length("body").cast(f.dataType).alias(f.name) if f.name == "n_chars"
        else F.col(f"row.`{f.name}`")
        for f in docs.schema
    ])
