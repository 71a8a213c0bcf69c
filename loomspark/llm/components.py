"""Connected components of a graph that no single machine holds.

Alternating large-star and small-star steps (Kiveris et al., "Connected
components in MapReduce and beyond"): each step replaces edges by edges to the
smallest neighbour, until every component is a star around its smallest node.
Neighbourhoods are only ever minimised (partial aggregation), never gathered,
and joined back by count (``join_counted``), so a node with very many
neighbours doesn't land in one task. Each step is
written to the shared folder; the driver only sees a count and a checksum.

A graph of at most ``small`` edges (16 bytes each) needs none of that: one task
labels its nodes with the smallest one that they reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm._common import join_counted, materialise, remove, ship, written


def labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node that each reaches)"""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    one, two = at[: len(u)], at[len(u) :]
    least = np.arange(len(nodes))
    while True:
        low = np.minimum(least[one], least[two])
        now = least.copy()
        # the roots of both ends take the smaller one, then paths are halved
        np.minimum.at(now, least[one], low)
        np.minimum.at(now, least[two], low)
        now = now[now]
        if (now == least).all():
            return nodes, nodes[least]
        least = now


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v")]) for b in batches]
    if parts:
        u, v = np.concatenate(parts, axis=1)
        node, root = labels(u, v)
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (written): u > v. Large: neighbours above u go to u's smallest; small: those below."""
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        out = join_counted(near, least, ["u"], "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = join_counted(edges, least, ["u"], "n")
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, u: str, v: str, small: int = 1 << 20) -> DataFrame:
    """node, root (the component's smallest node) of each node that has an edge to another one; node types must be ordered longs."""
    spark = edges.sparkSession
    edges = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v")
    path = written(edges, "edges")
    edges = spark.read.schema("u long, v long").parquet(path)
    if edges.count() <= small:
        ship(spark)
        out = materialise(edges.repartition(1).mapInArrow(_label, "node long, root long"), "components")
        remove(spark, path)
        return out
    before = None
    while (after := _signature(edges)) != before:
        before = after
        for large in (True, False):
            after_path = written(_star(edges, large), "edges")
            remove(spark, path)
            path, edges = after_path, spark.read.schema("u long, v long").parquet(after_path)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())
