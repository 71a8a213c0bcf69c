"""Hash-chained logs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.functions.udf import pandas

GENESIS = "0" * 64
FIELDS = ["seq", "ts", "session_id", "kind", "payload", "prev_hash"]


def canonical(record: dict) -> str:
    return json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def digest_of(record: dict) -> str:
    """SHA-256 of all fields but the hash, keys sorted, no spaces, ASCII."""
    return hashlib.sha256(canonical({k: v for k, v in record.items() if k != "hash"}).encode()).hexdigest()


@pandas("string")
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON texts with keys sorted and without spaces; null for what isn't JSON."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else canonical(json.loads(text))
        except ValueError:
            return None

    return texts.map(one)


@pandas("struct<seq:bigint,prev_hash:string,hash:string,digest:string>")
def _parsed(lines: pd.Series) -> pd.DataFrame:
    out = []
    for line in lines:
        try:
            r = json.loads(line)
            out.append((int(r["seq"]), str(r["prev_hash"]), str(r["hash"]), digest_of({k: r[k] for k in FIELDS})))
        except (ValueError, KeyError, TypeError):
            out.append((None, None, None, None))
    return pd.DataFrame(out, columns=["seq", "prev_hash", "hash", "digest"]).astype({"seq": "Int64"})


def chained(records: list[dict], prev: str = GENESIS, first: int = 0) -> Iterator[str]:
    """Lines to append, each with its predecessor's hash; a chain has one writer, so this runs on the driver, batch by batch."""
    for n, r in enumerate(records, first):
        r = {**r, "seq": n, "prev_hash": prev}
        prev = r["hash"] = digest_of({k: r[k] for k in FIELDS})
        yield json.dumps(r)


def verify_lines(lines: DataFrame) -> DataFrame:
    """ok, broken_at of ``line_no`` and ``value``: parsing and digests in parallel; links are compared with the next line by an equi-join, so no task holds the log."""
    rows = lines.where(F.trim("value") != "").select("line_no", _parsed("value").alias("r")).select("line_no", "r.*")
    return verify(rows)


def verify(rows: DataFrame) -> DataFrame:
    """rows: line_no (dense, from 0), seq, prev_hash, hash, digest. The first line that fails names its own seq, or the expected one if it can't be parsed."""
    before = rows.select((F.col("line_no") + 1).alias("line_no"), F.col("hash").alias("_before"))
    linked = rows.join(before, "line_no", "left")
    bad = F.col("seq").isNull() | (F.col("seq") != F.col("line_no")) | (F.col("prev_hash") != F.coalesce("_before", F.lit(GENESIS))) | (F.col("hash") != F.col("digest"))
    return linked.agg(F.min_by(F.coalesce("seq", "line_no"), F.when(bad, F.col("line_no"))).alias("broken_at")).select(F.col("broken_at").isNull().alias("ok"), "broken_at")


def text_chain(rows: DataFrame, order: str, payload: Column, chain: str | None = None) -> DataFrame:
    """order, payload digest and link to the one before, a chain for each key; for one chain over all rows ``text_log`` is there, which no task holds."""
    w = W.partitionBy(*([chain] if chain else [])).orderBy(order)
    digested = rows.select(*([chain] if chain else []), order, F.sha2(payload, 256).alias("hash"))
    return digested.withColumn("prev_hash", F.lag("hash", 1, GENESIS).over(w)).withColumn("seq", F.row_number().over(w) - 1)


def text_log(rows: DataFrame, order: str, payload: Column, width: int = 1 << 16) -> DataFrame:
    """line_no (dense, from 0), seq, payload, hash, prev_hash: one chain over all rows by the integer ``order``. Lines are counted within ranges of ``width`` numbers, links come from an equi-join, so no task holds the log."""
    told = rows.select(F.col(order).alias("_order"), F.floor(F.col(order) / width).alias("_range"), payload.alias("payload"))
    sizes = told.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(W.partitionBy("_range").orderBy("_order", "payload")) - 1
    lines = told.withColumn("_within", within).join(before, told["_range"].eqNullSafe(before["_range"]))
    lines = lines.select((F.col("_before") + F.col("_within")).alias("line_no"), "payload", F.sha2("payload", 256).alias("hash"))
    links = lines.select((F.col("line_no") + 1).alias("line_no"), F.col("hash").alias("prev_hash"))
    return lines.join(links, "line_no", "left").select("line_no", F.col("line_no").alias("seq"), "payload", "hash", F.coalesce("prev_hash", F.lit(GENESIS)).alias("prev_hash"))


def tail(rows: DataFrame, order: str, n: int) -> DataFrame:
    """O3: the last n, in order."""
    return rows.orderBy(F.desc(order)).limit(n).orderBy(order)


def unmatched_intents(intents: DataFrame, results: DataFrame) -> DataFrame:
    """Intents that no result refers to."""
    return intents.join(results.select(F.col("ref").alias("seq")), "seq", "left_anti")


def intent_results(intents: DataFrame, results: DataFrame) -> DataFrame:
    r = results.select(F.col("ref").alias("seq"), F.col("seq").alias("result_seq"))
    return intents.join(r, "seq", "left")
