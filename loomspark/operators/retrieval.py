"""Chunking, BM25, dense ranking and reciprocal rank fusion."""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.functions.numeric import dot, fixed
from loomspark.functions.text import packed_paragraphs, sections, strip, tokens, truncate
from loomspark.sources.scratch import materialise, ship

K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(docs: DataFrame, size: int = 2000, carry: int = 300) -> DataFrame:
    """doc_id, section, chunk_ix, text: headings first, then packed paragraphs; empty sections go."""
    parts = docs.select("doc_id", F.posexplode(sections(F.col("text"))).alias("s", "part"))
    parts = parts.where(F.length(strip(F.col("part.body"))) > 0)
    pieces = parts.select("doc_id", "s", F.col("part.section").alias("section"), F.posexplode(packed_paragraphs(F.col("part.body"), size, carry)).alias("p", "text"))
    return pieces.select("doc_id", "section", (F.col("s").cast("long") * F.lit(1 << 32) + F.col("p")).alias("chunk_ix"), "text")


def bm25(docs: DataFrame, query: str, key: str = "doc_id") -> DataFrame:
    """key, score of every document, 0 included.

    Two passes, one of them for the vocabulary: documents reduce to their length and the frequencies of the query's terms before anything is shuffled, so only
    counts and a row for each document leave the scan. Terms that more than half of the documents hold get the floor
    epsilon times the mean idf of the vocabulary, which takes the vocabulary's document frequencies.
    """
    terms = query_terms(query)
    toks = docs.select(F.col(key), tokens(F.coalesce("text", F.lit(""))).alias("t"))
    per_doc = toks.select(key, F.size("t").alias("dl"), *[_count("t", w).alias(f"tf{i}") for i, w in enumerate(dict.fromkeys(terms))])
    per_doc = materialise(per_doc, "lengths")  # numbers only; read for the averages and for the scores
    df = toks.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = per_doc.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    idf = df.join(F.broadcast(stats)).select("term", F.col("n"), F.col("avgdl"), (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    wanted = [F.max(F.when(F.col("term") == w, F.col("idf"))).alias(f"idf{i}") for i, w in enumerate(dict.fromkeys(terms))]
    model = idf.agg(F.max("n").alias("n"), F.max("avgdl").alias("avgdl"), F.avg("idf").alias("mean"), *wanted)  # one row
    scored = per_doc.join(F.broadcast(model))
    total = F.lit(0.0)
    counts = {w: terms.count(w) for w in terms}
    for i, (_, times) in enumerate(counts.items()):
        tf = F.col(f"tf{i}").cast("double")
        weight = F.when(F.col(f"idf{i}") < 0, EPSILON * F.col("mean")).otherwise(F.coalesce(f"idf{i}", F.lit(0.0)))
        total = total + times * weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.select(key, fixed(F.coalesce(total, F.lit(0.0))).alias("score"))


def _count(tokens_: str, term: str) -> Column:
    return F.size(F.filter(tokens_, lambda x: x == F.lit(term)))


def query_terms(query: str) -> list[str]:
    import re

    return re.findall(r"[a-z0-9][a-z0-9\-]*", query.lower())


def dense(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", block: int = 2048) -> DataFrame:
    """query, key, score, rank: the k best rows for each query by cosine of unit vectors (J3), ties by key.

    Queries are taken in blocks of at most ``block`` vectors, which bounds what is broadcast; each block is one pass over the vectors, in which
    a task keeps the k best of each query (and their ties), so what is sent on is k rows a query and task.
    """
    ship(vectors.sparkSession)
    kind = f"query {queries.schema[key].dataType.simpleString()}, {key} {vectors.schema[key].dataType.simpleString()}, score double"
    out = []
    for own in _blocks(queries, key, block):
        rows = own.collect()  # about ``block`` vectors
        sent = vectors.sparkSession.sparkContext.broadcast(([r[key] for r in rows], np.array([r["embedding"] for r in rows], float)))
        out.append(vectors.select(key, "embedding").mapInArrow(_nearest(sent, k, key), kind))
    out = reduce(DataFrame.union, out)
    best = W.partitionBy("query").orderBy(F.desc("score"), key)
    out = out.withColumn("score", fixed(F.col("score"))).withColumn("rank", F.row_number().over(best))
    return out.where(F.col("rank") <= k)


def _blocks(queries: DataFrame, key: str, block: int) -> list[DataFrame]:
    n = max(1, -(-queries.count() // block))
    told = queries.select(key, "embedding")
    return [told] if n == 1 else [told.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def _products(batch: pa.RecordBatch, queries: np.ndarray) -> np.ndarray:
    vectors = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float)
    return queries @ vectors.reshape(batch.num_rows, -1).T


def _nearest(sent, k: int, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = sent.value
        ids, scores = None, np.empty((len(names), 0))
        for b in batches:
            if not b.num_rows or not len(names):
                continue
            got = _products(b, queries)
            own = np.tile(b.column(key).to_numpy(zero_copy_only=False), (len(names), 1))
            ids, scores = (own, got) if ids is None else (np.concatenate((ids, own), 1), np.concatenate((scores, got), 1))
            if scores.shape[1] > 4 * k + 256:
                ids, scores = _cut(ids, scores, k)
        if ids is not None:
            for q, name in enumerate(names):
                low = np.sort(scores[q])[-min(k, scores.shape[1])] - 2e-6  # what rounds to the same score is a tie
                near = scores[q] >= low
                yield pa.RecordBatch.from_arrays([pa.array([name] * int(near.sum())), pa.array(ids[q][near]), pa.array(scores[q][near])], ["query", key, "score"])

    return run


def _cut(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As many of each query's rows as the one with most ties needs."""
    order = np.argsort(-scores, 1)
    ranked = np.take_along_axis(scores, order, 1)
    width = int((ranked >= ranked[:, k - 1 : k] - 2e-6).sum(1).max())
    return np.take_along_axis(ids, order[:, :width], 1), ranked[:, :width]


def dense_ranks(vectors: DataFrame, queries: DataFrame, wanted: DataFrame, key: str = "vec_id", block: int = 2048) -> DataFrame:
    """query, key, rank over all vectors of each wanted (query, key), ties by key: for each of them the rows before it are counted, task by task, in blocks of queries as in ``dense``."""
    ship(vectors.sparkSession)
    told = vectors.select(key, "embedding")
    kind = f"query {queries.schema[key].dataType.simpleString()}, place int, n long"
    asked = queries.select(F.col(key).alias("query"), F.col("embedding").alias("_q"))
    pairs = told.join(wanted, key).join(asked, "query")
    pairs = materialise(pairs.select("query", key, dot(F.col("embedding"), F.col("_q")).alias("score")), "wanted")
    out = []
    for own in _blocks(queries, key, block):
        rows = {r[key]: r["embedding"] for r in own.collect()}
        lists: dict = {name: [] for name in rows}
        for r in pairs.join(F.broadcast(own.select(F.col(key).alias("query"))), "query").toLocalIterator():
            lists[r["query"]].append((-_rounded(r["score"]), r[key]))
        lists = {name: sorted(x) for name, x in lists.items()}
        sent = vectors.sparkSession.sparkContext.broadcast((list(rows), np.array(list(rows.values()), float), list(lists.values())))
        counts = told.mapInArrow(_places(sent, key), kind).groupBy("query", "place").agg(F.sum("n").alias("n"))
        numbered = [(name, i, x[1]) for name, found in lists.items() for i, x in enumerate(found)]
        names = vectors.sparkSession.createDataFrame(numbered, f"query {queries.schema[key].dataType.simpleString()}, place int, {key} {vectors.schema[key].dataType.simpleString()}")
        upto = F.sum("n").over(W.partitionBy("query").orderBy("place"))
        before = names.join(counts, ["query", "place"], "left").select("query", "place", key, F.coalesce("n", F.lit(0)).alias("n"))
        out.append(before.select("query", key, (upto + 1).alias("rank")))
    return reduce(DataFrame.union, out)


def _rounded(score):
    """As ``fixed`` does: half away from zero, six digits."""
    return np.sign(score) * np.floor(np.abs(score) * 1e6 + 0.5)


def _places(sent, key: str):
    """Of each query, how many rows come first at each place: before the wanted row there, but not before the one ahead of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries, lists = sent.value
        levels = [np.array([x[0] for x in own], float) for own in lists]
        counts = [np.zeros(len(own) + 1, np.int64) for own in lists]
        for b in batches:
            if not b.num_rows or not len(names):
                continue
            ids = b.column(key).to_pylist()
            for q, scores in enumerate(-_rounded(_products(b, queries))):
                place, tied = np.searchsorted(levels[q], scores, "left"), np.searchsorted(levels[q], scores, "right")
                for i in np.flatnonzero(tied > place).tolist():
                    place[i] = bisect.bisect_right(lists[q], (scores[i], ids[i]))
                counts[q] += np.bincount(place, minlength=len(counts[q]))
        for name, own in zip(names, counts):  # noqa: B905  as many of each
            at = np.flatnonzero(own)
            if not len(at):
                continue
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(own[at])], ["query", "place", "n"])

    return run


def top(scored: DataFrame, key: str, k: int) -> DataFrame:
    """Ties by key; a top-k never sorts the whole table."""
    return scored.orderBy(F.desc("score"), key).limit(k)


def positions(rows: DataFrame, order: list[Column], within: list[str] = []) -> DataFrame:  # noqa: B006  never changed
    """rows with position (from 0, among those equal in ``within``, which the order begins with) and total.

    Rows are dealt to ranges and written once; a row's position is that within its range plus the sizes of the ranges before, so no task
    sees all rows, or all of a group. The sizes are one row for each range and group in it.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id())
    dealt = materialise(dealt, "ranges")
    sizes = dealt.groupBy("_p", *within).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy(*within).orderBy("_p"))
    before = sizes.select(F.col("_p").alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in within], (upto - F.col("n")).alias("before"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    dealt = dealt.withColumn("_r", F.row_number().over(W.partitionBy("_p", *within).orderBy(*order)) - 1)
    on = [dealt["_p"] == before["_b"], *[dealt[c].eqNullSafe(before[f"_b_{c}"]) for c in within]]
    out = dealt.join(F.broadcast(before), on).join(F.broadcast(total))
    return out.select(*rows.columns, (F.col("_r") + F.col("before")).alias("position"), "total")


def ranks(scored: DataFrame, key: str) -> DataFrame:
    """Key, score, rank (from 1), ties by key."""
    out = positions(scored.select(key, "score"), [F.desc("score"), F.col(key)])
    return out.select(key, "score", (F.col("position") + 1).alias("rank"))


def fuse(rankings: list[DataFrame], key: str, k: int = 5) -> DataFrame:
    """Sum of 1 / (60 + rank) over the rankings, best k."""
    parts = [r.select(F.col(key).alias(key), (1.0 / (RRF_K + F.col("rank"))).alias("part")) for r in rankings]
    return top(reduce(DataFrame.unionByName, parts).groupBy(key).agg(fixed(F.sum("part"), 9).alias("score")), key, k)


def hybrid(ranked: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id") -> DataFrame:
    """query, id, score: the k best of the fusion of one ranking (id, rank; written) with each query's dense ranking.

    The k first of the ranking score 1 / (60 + k) or more; what is beyond place 60 + 2 k in both scores 2 / (61 + 60 + 2 k) at most, which is
    less. So the candidates are the first rows of both, and only for these the other rank is looked up or counted; no query ranks all rows.
    """
    deep = RRF_K + 2 * k
    near = dense(vectors, queries, deep, key).select("query", F.col(key).alias("id"))
    first = queries.select(F.col(key).alias("query")).join(F.broadcast(ranked.where(F.col("rank") <= deep).select("id")))  # ``deep`` rows a query
    wanted = materialise(near.union(first).distinct(), "candidates")
    lexical = wanted.join(ranked, "id").select("query", "id", "rank")
    dense_part = dense_ranks(vectors, queries, wanted.withColumnRenamed("id", key), key).withColumnRenamed(key, "id")
    both = lexical.unionByName(dense_part.select("query", "id", "rank"))
    fused = both.groupBy("query", "id").agg(fixed(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("score"))
    best = W.partitionBy("query").orderBy(F.desc("score"), "id")
    return fused.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")


def rendered(hits: DataFrame, limit: int = 6000) -> DataFrame:
    """The answer of a search: [doc - section], text, in order of score, cut at ``limit`` characters. ``hits`` is a top-k."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "chunk_ix", F.format_string("[%s — %s]\n%s", F.col("doc_id").cast("string"), "section", "text").alias("s"))))
    return hits.agg(truncate(F.array_join(F.transform(rows, lambda x: x["s"]), "\n\n---\n\n"), limit, "\n[truncated]").alias("output"))


QUERY = "general public license version"


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(bm25(table(spark, sf_dir, "documents"), QUERY), "doc_id", 10)
