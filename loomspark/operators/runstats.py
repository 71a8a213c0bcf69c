"""Training metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.functions.numeric import fixed
from loomspark.functions.text import duration


def series(rows: DataFrame, key: str) -> DataFrame:
    """R2"""
    return rows.where(F.col(key).isNotNull()).select("run_id", "step", F.col(key).alias("value"))


def band(gb: Column) -> Column:
    """R6"""
    return F.when(F.coalesce(gb, F.lit(0.0)) == 0, "none").when(gb > 5.2, "over").when(gb > 4.8, "near").otherwise("ok")


def tiles(rows: DataFrame) -> DataFrame:
    """First and last values that aren't null, the peak, the band; of the last row progress, seconds a step and seconds left."""
    at = lambda f, c: f(F.col(c), F.when(F.col(c).isNotNull(), F.col("step")))
    totals = [at(F.max_by, "total_steps").alias("total_steps")] if "total_steps" in rows.columns else []
    out = rows.groupBy("run_id").agg(
        at(F.min_by, "loss").alias("first_loss"), at(F.max_by, "loss").alias("last_loss"), F.max(F.coalesce("vram_gb", F.lit(0.0))).alias("peak_gb"), F.max("step").alias("step"), F.max("t").alias("elapsed"), *totals
    )
    out = out.withColumn("band", band(F.col("peak_gb")))
    if not totals:
        return out
    per, left, pct = progress(F.col("step"), F.col("total_steps"), F.col("elapsed"))
    return out.withColumns({"per_step": fixed(per), "eta": duration(left), "pct": fixed(pct, 2)})


def progress(step: Column, total: Column, elapsed: Column) -> tuple[Column, Column, Column]:
    """seconds a step, seconds left, percent"""
    per = F.try_divide(elapsed, step)
    return per, per * (total - step), F.try_divide(100 * step, total)


def last_rows(rows: DataFrame, n: int = 40) -> DataFrame:
    """R4"""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("step")))).where(F.col("_r") <= n).drop("_r")


def run_index(configs: DataFrame, summaries: DataFrame, metrics: DataFrame) -> DataFrame:
    """Runs with or without summary and metrics, newest name first; without a summary a run is still running."""
    last = tiles(metrics).select("run_id", "last_loss", "peak_gb")
    out = configs.join(summaries, "run_id", "left").join(last, "run_id", "left")
    status = F.coalesce("status", F.lit("running")) if "status" in out.columns else F.lit("running")
    return out.withColumn("status", status).withColumn("peak_gb", F.coalesce("peak_gb", F.lit(0.0))).orderBy(F.desc("run_id"))
