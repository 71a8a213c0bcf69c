"""Toxicity by maximum-scoring segments.

Tokens are words and their beginnings of 4, 6 and 8 characters, so that rare
forms share what is known of their stem. Tokens get log-odds between toxic and
other labelled documents, with an informative Dirichlet prior (Monroe et al.,
"Fightin' Words"); a document counts 1 + ln(occurrences), as words come in
bursts. A token's z is the signed root of the likelihood ratio of its rates in
both kinds, which needs no clean use to be large. Tokens whose z is under
``min_z`` are background, and background
costs ``drift`` a word, so that scores fall in expected value; a word has the
weight of its most significant token. A linear-time scan (Ruzzo and Tompa)
finds all maximal segments. Scores are taken in extreme-value form (Karlin and
Altschul): x = lambda S - ln(K n), with lambda and K fitted on clean documents;
segments whose expected number in a clean text of that length is under
``max_expected`` are significant, and all of them are returned. A text's
evidence is that of its significant segments together: the largest, over r, of
-ln of the chance that the r best of a clean text sum up to as much (Karlin and
Altschul's sum statistic, e^-t t^(r-1) / (r! (r-1)!) for the sum t), with ln 2
off for each further segment. Without a significant one it is the best x. A
logistic curve of evidence, fitted on the same labelled rows, gives the score.

Fitted on a bounded sample: ``sample_docs`` labelled documents with the
smallest hash of their id (then the smallest id), written once. The model is
the ``max_words`` most significant tokens of that sample and is broadcast.
Labels of one id: toxic if any says so. Null and empty texts have no evidence
and get the curve's score for that; long texts are read whole. Every row gets
its own result, equal ones the same; columns of any name are kept. Without
labelled rows of both kinds the score is 0.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm._common import LOWER_ALNUM, column_bytes, materialise, packed, ship, with_row


class Weights(dict):
    """word -> weight or None, from the tokens' (z, weight); forgets all beyond a bound."""

    def __init__(self, tokens: dict[bytes, tuple[float, float]], most: int = 100_000):
        self.tokens, self.most = tokens, most

    def __missing__(self, word: bytes) -> float | None:
        if len(self) >= self.most:
            self.clear()
        found = [self.tokens[t] for t in tokens_of(word) if t in self.tokens]
        w = self[word] = max(found)[1] if found else None
        return w


def tokens_of(word: bytes) -> list[bytes]:
    """The word, and its beginnings, marked by a star."""
    text = word.decode("utf-8", "replace")
    return [word if len(word) <= LONG else b"#" + xxhash.xxh3_128_digest(word), *[text[:n].encode() + b"*" for n in (4, 6, 8) if len(text) >= n]]


#: Bytes of a word beyond which its digest stands for it.
LONG = 64


@dataclass
class Model:
    weights: dict[bytes, tuple[float, float]] = field(default_factory=dict)
    drift: float = 0.02
    lam: float = 1.0
    ln_k: float = 0.0
    curve: tuple[float, float] = (-10.0, 0.0)
    max_expected: float = 0.05


def maximal_segments(positions: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """(start, end, score) of all maximal-scoring segments of a sequence that is -drift but for these positions; scores > 0 start them.

    Ruzzo and Tompa's algorithm; stretches of background are one step. Each candidate knows the nearest one before it that starts lower, where its own
    search ended, so that no search walks over the same candidates again.
    """
    out: list[tuple[int, int, float, float, int]] = []  # start, end, left total, right total, nearest candidate with a lower left total
    total, at = 0.0, 0
    for p, s in zip(positions, scores):  # noqa: B905
        total -= drift * (p - at)
        at = p + 1
        if s <= 0:
            total += s
            continue
        start, left = p, total
        total += s
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= left:
                j = out[j][4]
            if j < 0 or out[j][3] >= total:
                break
            start, _, left, _, lower = out[j]
            del out[j:]
            j = lower
        out.append((start, at, left, total, j))
    return [(a, b, right - left) for a, b, left, right, _ in out]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER_ALNUM).split()


def segments(text: bytes, known: Weights, drift: float) -> tuple[list[tuple[int, int, float]], int, int]:
    """(maximal segments, words, known words)"""
    words = words_of(text)
    hits = [(i, w) for i, w in enumerate(map(known.__getitem__, words)) if w is not None]
    return maximal_segments([i for i, _ in hits], [w for _, w in hits], drift), len(words), len(hits)


def together(x: list[float]) -> float:
    """Evidence of significant segments: the best of -ln of the chances of the 1, 2, .. largest."""
    best = total = 0.0
    for r, own in enumerate(sorted(x, reverse=True), 1):
        total += own
        chance = -total + (r - 1) * math.log(max(total, 1.0)) - math.lgamma(r + 1) - math.lgamma(r) + (r - 1) * math.log(2)
        best = max(best, -chance)
    return best


def evidence(text: bytes, model: Model, known: Weights) -> tuple[float, list[tuple[int, int, float]], int]:
    """(evidence, at least -20; significant segments; words)"""
    found, n, _ = segments(text, known, model.drift)
    if not found:
        return -20.0, [], n
    base = model.ln_k + math.log(n)
    significant = [x for x in found if model.lam * x[2] - base > -math.log(model.max_expected)]
    if significant:
        return together([model.lam * s - base for _, _, s in significant]), significant, n
    return max(model.lam * max(s for _, _, s in found) - base, -20.0), [], n


def _lambda(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum p e^(lambda s) = 1; the expected score is below zero."""
    low, high = 0.0, 1.0
    value = lambda x: float((shares * np.exp(np.minimum(x * scores, 700))).sum()) - 1
    while value(high) < 0 and high < 64:
        low, high = high, 2 * high
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return max(high, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    centre, width = x.mean(), x.std() or 1.0
    a = np.stack([np.ones_like(x), (x - centre) / width], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-6)[:, None]) + ridge * np.eye(2), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] - w[1] * centre / width), float(w[1] / width)


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, sample_docs: int = 12_000, max_words: int = 200_000, prior: float = 50.0, min_z: float = 4.0, drift: float = 0.02) -> Model:
    """A model from the labelled rows for which ``allowed`` (a condition on ``doc_id``) holds."""
    spark = docs.sparkSession
    ship(spark)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & allowed)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).collect()
    chosen_rows = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in chosen], "_id long, toxic int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = rows.join(F.broadcast(chosen_rows), rows["doc_id"] == chosen_rows["_id"])  # at most sample_docs rows of 12 bytes
    sample = materialise(sample.select("text", "toxic").repartition(spark.sparkContext.defaultParallelism), "sample")

    def each_token(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                few = b.slice(at, 256)
                sums: dict[tuple[bytes, int], list[float]] = {}
                for text, t in zip(column_bytes(few, "text"), few.column("toxic").to_pylist()):  # noqa: B905
                    own = Counter(words_of(text))
                    seen: Counter = Counter({b"": 1})
                    for w, n in own.items():
                        for x in tokens_of(w):
                            seen[x] += n
                    for x, n in seen.items():
                        into = sums.setdefault((x, t), [0.0, 0])
                        into[0] += 1 + math.log(n)
                        into[1] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in sums], pa.binary()), pa.array([k[1] for k in sums], pa.int32()), pa.array([v[0] for v in sums.values()], pa.float64()), pa.array([v[1] for v in sums.values()], pa.int64())],
                    ["word", "toxic", "amount", "docs"],
                )

    held = sample.mapInArrow(each_token, "word binary, toxic int, amount double, docs long")
    counts = held.groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("amount")).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("toxic") == 1, 0.0).otherwise(F.col("amount"))).alias("b"), F.sum("docs").alias("docs")
    )
    counts = counts.where((F.col("docs") >= 3) | (F.length("word") == 0))
    counts = materialise(counts, "tokens")
    # the empty word stands for the documents themselves
    total = counts.where(F.length("word") == 0).first()
    if total is None or not total["a"] or not total["b"]:
        return Model(drift=drift)
    n_a, n_b = float(total["a"]), float(total["b"])
    # rates are per document of each kind; the prior is that of both kinds together
    share = (F.col("a") + F.col("b")) / F.lit(n_a + n_b)
    one, two = F.col("a") + prior * share, F.col("b") + prior * share
    odds = F.log(one / (n_a + prior)) - F.log(two / (n_b + prior))
    # 2 sum of observed ln(observed / expected), 0 where nothing is observed; the variance of log-odds would be that of the prior alone for a word of one kind
    part = lambda x, n: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / (share * n))).otherwise(0.0)
    ratio = F.greatest(2 * (part("a", n_a) + part("b", n_b)), F.lit(0.0))
    ranked = counts.where(F.length("word") > 0).select("word", "a", "b", odds.alias("odds"), (F.signum(odds) * F.sqrt(ratio)).alias("z"))
    top = ranked.where(F.col("z") >= min_z).orderBy(F.desc("z"), "word").limit(max_words).collect()
    model = Model({bytes(r["word"]): (float(r["z"]), float(r["odds"])) for r in top}, drift)
    if not model.weights:
        return model

    sent = spark.sparkContext.broadcast(model.weights)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Weights(sent.value)
        for b in batches:
            got = []
            for text in column_bytes(b, "text"):
                found, words, hits = segments(text, known, drift)
                got.append((max((s for _, _, s in found), default=0.0), words, hits))
            cols = list(zip(*got)) or [(), (), ()]  # noqa: B905
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["toxic", "best", "words", "hits"])

    seen = sample.mapInArrow(scan, "toxic int, best double, words long, hits long").collect()  # sample_docs rows of numbers
    toxic, best, words, hits = (np.array([r[i] for r in seen], float) for i in range(4))
    clean = toxic == 0
    # background of clean texts: the model's words at their clean rates, all else -drift
    n_words = max(words[clean].sum(), 1.0)
    weights = np.array([w for _, w in model.weights.values()])
    rates = np.array([r["b"] for r in top], float) + 0.5
    rates *= max(hits[clean].sum(), 0.5) / n_words / rates.sum()
    model.lam = _lambda(np.append(weights, -drift), np.append(rates, 1 - rates.sum()))
    # K: of clean texts, a segment that scores x or more is expected K n e^(-lambda x) times
    level = max(float(np.median(weights)), 1e-6)
    seen_over = max(float((best[clean] >= level).sum()), 0.5)
    model.ln_k = math.log(seen_over / n_words) + model.lam * level
    known = scored(sample.select(F.struct("toxic").alias("row"), F.col("text").alias("body")), model)
    curve = known.select("row.toxic", "evidence").collect()  # sample_docs rows of numbers
    model.curve = _logistic(np.array([r["evidence"] for r in curve]), np.array([r["toxic"] for r in curve], float))
    return model


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` has ``row`` (anything) and ``body`` (a text): row, score, evidence, n_words, passages."""
    spark = rows.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        known = Weights(m.weights)
        a, c = m.curve
        for b in batches:
            got = [evidence(x, m, known) for x in column_bytes(b, "body")]
            score = [1 / (1 + math.exp(-max(-30.0, min(30.0, a + c * x)))) if m.weights else 0.0 for x, _, _ in got]
            passages = [[{"start": s, "end": e, "score": v} for s, e, v in found] for _, found, _ in got]
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array(score, pa.float64()), pa.array([x[0] for x in got], pa.float64()), pa.array([x[2] for x in got], pa.int64()), pa.array(passages, kind)],
                ["row", "score", "evidence", "n_words", "passages"],
            )

    return rows.select("row", "body").mapInArrow(
        run, with_row(rows, "score double, evidence double, n_words long, passages array<struct<start:int,end:int,score:double>>")
    )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), evidence, n_words and the significant passages (word spans) of every row's whole text."""
    return scored(packed(docs, ["doc_id"]), model).select("row.*", "score", "evidence", "n_words", "passages")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows that score less, with their columns."""
    return scored(packed(docs, docs.columns), model).where(F.col("score") < threshold).select("row.*")
