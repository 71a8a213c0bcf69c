"""Models under a memory budget, and the model of each route."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def verdicts(models: DataFrame, profiles: DataFrame, profile: str) -> DataFrame:
    """models and reason (null: accepted), under the budget of the profile of that name.

    A repeated id loses to an accepted model before it in the file, whatever it claims; models on a CPU have no budget.
    """
    own = profiles.where(F.col("id") == profile).select(F.col("id").alias("_profile"), F.col("budget_gb").alias("_budget")).limit(1)
    over = (F.col("device") == "gpu") & (F.col("vram_gb") > F.col("_budget"))
    joined = models.join(F.broadcast(own)).withColumn("_over", over)
    first = F.min(F.when(~F.col("_over"), F.col("ord"))).over(W.partitionBy("id"))
    claim = F.concat(F.lit("claims "), F.col("vram_gb").cast("string"), F.lit(" GB, profile '"), "_profile", F.lit("' budget is "), F.col("_budget").cast("string"), F.lit(" GB"))
    reason = F.when(F.col("ord") > first, F.lit("duplicate id")).when(F.col("_over"), claim)
    return joined.select(*models.columns, reason.alias("reason"))


def accepted(judged: DataFrame, fallback: str) -> DataFrame:
    """The accepted models; ValueError if there is none, or the fallback isn't one of them."""
    out = judged.where(F.col("reason").isNull()).drop("reason")
    n, has = out.agg(F.count(F.lit(1)), F.max((F.col("id") == fallback).cast("int"))).first()
    if not n:
        raise ValueError("every model was rejected")
    if not has:
        raise ValueError(f"fallback {fallback!r} is not an accepted model")
    return out


def resolve(accepted: DataFrame, tasks: DataFrame, fallback: str) -> DataFrame:
    """task, model_id, used_fallback: of the models that declare the route the first by priority, memory and file order; else the fallback."""
    offers = accepted.select(F.explode("routes").alias("task"), "id", "priority", "vram_gb", "ord")
    best = offers.groupBy("task").agg(F.min_by("id", F.struct("priority", "vram_gb", "ord")).alias("best"))
    return tasks.join(best, "task", "left").select("task", F.coalesce("best", F.lit(fallback)).alias("model_id"), F.col("best").isNull().alias("used_fallback"))
