"""Training traces: profile, splits, dedupe, prefixes, masks, sampling."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.operators.audit import canonical_json
from loomspark.operators.retrieval import positions


def profile(turns: DataFrame) -> DataFrame:
    """Of conv_id, turn, role, text."""
    per = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.min_by("text", "turn").alias("prompt"), F.array_sort(F.collect_set("role")).alias("roles"))
    return per.agg(F.count(F.lit(1)).alias("traces"), F.count_distinct("prompt").alias("prompts"), F.count_distinct("roles").alias("role_sets"), F.max("turns").alias("longest"), F.sum("turns").alias("turns"))


def tool_sets(turns: DataFrame, tools: list[str], offer: str = "text") -> DataFrame:
    """conv_id, offered: the sorted set of tools that the first turn offers (as `- name(`)."""
    first = turns.groupBy("conv_id").agg(F.min_by(offer, "turn").alias("first"))
    found = F.array_compact(F.array(*[F.when(F.contains("first", F.lit(f"- {name}(")), F.lit(name)) for name in sorted(tools)]))
    return first.select("conv_id", found.alias("offered"))


def actions(turns: DataFrame, content: str = "text") -> DataFrame:
    """Action, first, calls: how often each tool is an assistant's first action, and how often it is called; <answer> is a turn without one."""
    said = turns.where("role = 'assistant'").select("conv_id", "turn", F.coalesce(F.get_json_object(content, "$.tool"), F.lit("<answer>")).alias("action"))
    first = said.groupBy("conv_id").agg(F.min_by("action", "turn").alias("action")).select("action", F.lit(1).alias("first"), F.lit(0).alias("calls"))
    calls = said.select("action", F.lit(0).alias("first"), F.when(F.col("action") != "<answer>", 1).otherwise(0).alias("calls"))
    return first.union(calls).groupBy("action").agg(F.sum("first").alias("first"), F.sum("calls").alias("calls"))


def histogram(turns: DataFrame) -> DataFrame:
    """Turns, n: how many conversations have so many turns."""
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns")).groupBy("turns").agg(F.count(F.lit(1)).alias("n"))


def alternation(turns: DataFrame) -> DataFrame:
    """User and assistant take turns (an opening system turn apart), and the assistant has the last word."""
    w = W.partitionBy("conv_id").orderBy("turn")
    step = turns.withColumn("_same", (F.col("role") == F.lag("role").over(w)).cast("int"))
    out = step.groupBy("conv_id").agg(F.coalesce(F.max("_same"), F.lit(0)).alias("same"), F.max_by("role", "turn").alias("last"))
    return out.select("conv_id", (F.col("same") == 0).alias("alternates"), (F.col("last") == "assistant").alias("ends_on_assistant"))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, turn, n_before, chars_before of each assistant turn; counts stream through the window, texts aren't gathered."""
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    out = turns.select("conv_id", "turn", "role", F.count(F.lit(1)).over(w).alias("n_before"), F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).alias("chars_before"))
    return out.where("role = 'assistant'").drop("role")


def prefix_messages(turns: DataFrame) -> DataFrame:
    """The earlier messages of each assistant turn, as an array."""
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    return turns.withColumn("before", F.collect_list(F.struct("role", "text")).over(w)).where("role = 'assistant'")


def split_by_prompt(turns: DataFrame, every: int = 5) -> DataFrame:
    """conv_id, prompt, side: by the prompt's digest, so that equal prompts are on one side."""
    first = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("prompt"))
    bucket = F.conv(F.substring(F.md5(F.coalesce("prompt", F.lit(""))), 1, 6), 16, 10).cast("long") % every
    return first.select("conv_id", "prompt", F.when(bucket == 0, "eval").otherwise("train").alias("side"))


def leaked(split: DataFrame) -> DataFrame:
    """Prompts on both sides."""
    return split.where("side = 'train'").select("prompt").intersect(split.where("side = 'eval'").select("prompt"))


def missing(want: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """J13"""
    return want.join(have.select(key).distinct(), key, "left_anti")


def exact_dedupe(rows: DataFrame, value: Column, order: str) -> DataFrame:
    """The first row of each value; only digests and the order are shuffled."""
    return rows.groupBy(F.sha2(value, 256).alias("digest")).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("copies"))


def canonical_dedupe(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Of JSON texts; the order of keys and white space make no difference."""
    return exact_dedupe(rows.select(order, canonical_json(value).alias("_v")), F.col("_v"), order)


def strided(rows: DataFrame, order: str, n: int) -> DataFrame:
    """Each stride-th row, n at most; stride = max(1, rows // n)."""
    out = positions(rows.select(order), [F.col(order)])
    stride = F.greatest(F.floor(F.col("total") / n), F.lit(1))
    return out.where((F.col("position") % stride == 0) & (F.col("position") < stride * n)).select(order)


def downsampled(rows: DataFrame, order: str, most: int = 400) -> DataFrame:
    """Over ``most`` points, each (rows // most + 1)-th, and the last."""
    out = positions(rows.select(order), [F.col(order)])
    stride = F.when(F.col("total") > most, F.floor(F.col("total") / most) + 1).otherwise(1)
    return out.where((F.col("position") % stride == 0) | (F.col("position") == F.col("total") - 1)).select(order)


def preview(rows: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first n in order."""
    return rows.orderBy(*order).limit(n)


def chance(key: Column, seed: int) -> Column:
    """A number from 0 up to 1 that follows from key and seed alone, in any engine: the first 8 hexadecimal digits of a digest."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("long") / float(1 << 32)


def weighted_draws(spark: SparkSession, weights: list[tuple[str, float]], n: int, seed: int = 0) -> DataFrame:
    """Draw, choice: n draws with replacement, each by its own number, so any part of them can be drawn anywhere."""
    total, upto, pick = sum(w for _, w in weights), 0.0, F.lit(weights[-1][0])
    u = chance(F.col("id"), seed)
    bounds = []
    for name, w in weights[:-1]:
        upto += w
        bounds.append((name, upto / total))
    for name, bound in reversed(bounds):
        pick = F.when(u < bound, name).otherwise(pick)
    return spark.range(n).select(F.col("id").alias("draw"), pick.alias("choice"))


def sampled(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """N rows without replacement, those with the smallest numbers; a top-n, never a sort of all rows."""
    return rows.orderBy(chance(F.col(key), seed), key).limit(n)


def shuffled(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Key and position in an order that follows from the seed."""
    return positions(rows.select(key, chance(F.col(key), seed).alias("_u")), [F.col("_u"), F.col(key)]).select(key, "position")


#: A family of traces: its name, what makes conv_id, turn, role, text of a number of facts, and its share.
Family = tuple[str, Callable[[DataFrame], DataFrame], float]


def composed(facts: DataFrame, families: list[Family], total: int, key: str = "doc_id", seed: int = 0) -> DataFrame:
    """Each family makes traces of its share of ``total`` facts, drawn with replacement; family and the rows that it makes."""
    facts = positions(facts, [F.col(key)])
    out = []
    for i, (name, make, share) in enumerate(families):
        n = int(total * share)
        drawn = facts.sparkSession.range(n).select(F.col("id").alias("trace"), chance(F.col("id"), seed * 1000 + i).alias("_u"))
        drawn = drawn.join(F.broadcast(facts.agg(F.max("total").alias("_n")))).withColumn("position", F.floor(F.col("_u") * F.col("_n"))).drop("_u", "_n")
        out.append(make(drawn.join(facts.drop("total"), "position").drop("position")).withColumn("family", F.lit(name)))
    return reduce(DataFrame.unionByName, out)


def retained(raw: int, encoded: int) -> str | None:
    """P25: ValueError if nothing survives, a warning if under nine tenths do."""
    if not encoded:
        raise ValueError(f"none of {raw} traces could be encoded")
    return f"kept only {encoded} of {raw} traces" if encoded < 0.9 * raw else None


def label_mask(ids: Column, spans: Column) -> Column:
    """ids within the spans (struct<start, end>), -100 elsewhere."""
    return F.transform(ids, lambda x, i: F.when(F.exists(spans, lambda s: (i >= s["start"]) & (i < s["end"])), x).otherwise(F.lit(-100)))


def encoded(ids: Column, spans: Column, longest: int) -> Column:
    """the labels of a trace; null if it is too long, or nothing in it is supervised."""
    mask = label_mask(ids, spans)
    return F.when((F.size(ids) <= longest) & F.exists(mask, lambda x: x != -100), mask)


def is_prefix(whole: Column, part: Column) -> Column:
    """what is rendered up to a turn has to begin the whole."""
    return F.slice(whole, 1, F.size(part)) == part


def padded(ids: Column, size: Column, fill: int) -> Column:
    """F40"""
    return F.concat(ids, F.array_repeat(F.lit(fill), F.greatest(size - F.size(ids), F.lit(0)).cast("int")))


def collated(rows: DataFrame, batch: str, pad: int) -> DataFrame:
    """ids, labels and attention mask of each row, padded to the longest of its batch."""
    width = rows.groupBy(batch).agg(F.max(F.size("ids")).alias("_width"))
    out = rows.join(width, batch)
    ones = F.transform("ids", lambda _: F.lit(1))
    return out.select(*[c for c in rows.columns if c not in ("ids", "labels")], padded(F.col("ids"), F.col("_width"), pad).alias("ids"), padded(F.col("labels"), F.col("_width"), -100).alias("labels"), padded(ones, F.col("_width"), 0).alias("mask"))


def infix(program: Column) -> Column:
    """the one step of a program, as `operation(a, b)`, in infix form; null for several steps, other operations and arguments that aren't numbers."""
    number = r"\s*((?:const_)?-?\d+(?:\.\d+)?%?)\s*"
    pattern = rf"^\s*(add|subtract|multiply|divide)\({number},{number}\)\s*,?\s*$"
    part = lambda i: F.replace(F.regexp_extract(program, pattern, i), F.lit("const_"), F.lit(""))
    sign = F.element_at(F.create_map(*map(F.lit, ("add", "+", "subtract", "-", "multiply", "*", "divide", "/"))), F.nullif(part(1), F.lit("")))
    return F.when(F.regexp_like(program, F.lit(pattern)), F.concat_ws(" ", part(2), sign, part(3)))


def supervised_ratio(encoded: DataFrame) -> DataFrame:
    """A19"""
    return encoded.agg(F.try_divide(F.sum(F.size(F.filter("labels", lambda x: x != -100))), F.sum(F.size("labels"))).alias("ratio"))


def budget_crossing(steps: DataFrame, cap: int) -> DataFrame:
    """The first step of each run at which tokens spent reach the cap."""
    w = W.partitionBy("run_id").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    return steps.withColumn("spent", F.sum("tokens").over(w)).where(F.col("spent") >= cap).groupBy("run_id").agg(F.min("step").alias("step"))
