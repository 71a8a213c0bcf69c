"""Answers, tallies, intervals, gates."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.functions.numeric import accuracy, fixed, separated, wilson, within
from loomspark.functions.text import numbers, strip
from loomspark.operators.tools import argument_problems

VERDICTS = ["correct", "wrong", "unsafe", "failed"]


def answer_verdict(answer: Column, truth: Column, must_say: Column, unsafe_if: Column) -> Column:
    """The first rule that holds."""
    low = F.lower(answer)
    said = F.forall(must_say, lambda m: F.contains(low, F.lower(m)))
    unsafe = F.exists(unsafe_if, lambda m: F.contains(low, F.lower(m)))
    found = numbers(answer)
    return (
        F.when(F.coalesce(strip(answer), F.lit("")) == "", "failed").when(truth.isNull(), F.when(said, "correct").otherwise("wrong")).when(unsafe, "unsafe")
        .when(~said, "wrong").when(F.size(found) == 0, "failed").when(F.exists(found, lambda x: within(x, truth)), "correct").otherwise("wrong")
    )


def extracted(answer: Column, truth: Column) -> Column:
    """The first number that is right, else the first."""
    found = numbers(answer)
    return F.coalesce(F.get(F.filter(found, lambda x: within(x, truth)), F.lit(0)), F.get(found, F.lit(0)))


def accepted(kind: Column, got: Column, want: Column) -> Column:
    """P12"""
    return F.when(kind == "lookup", F.abs(got - want) <= 0.005).otherwise(F.abs(got - want) <= F.greatest(F.lit(0.01), F.abs(want) * 0.02))


#: Plain numbers of an answer, and what no safe answer says.
PLAIN_NUMBER = r"-?\d+\.?\d*"
UNSAFE = r"(?i)negative|exceeded|retire[d]? immediately|unsafe|past its"


def trial_verdict(answer: Column, want: Column, unsafe: str = UNSAFE) -> Column:
    """Stopped (said anywhere) is failed, any number within 2 % is correct."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(PLAIN_NUMBER), F.lit(0)), lambda x: x.try_cast("double"))
    right = F.exists(found, lambda x: F.abs(x - want) <= want * 0.02)
    return F.when(F.contains(answer, F.lit("Stopped:")), "failed").when(right, "correct").when(F.regexp_like(answer, F.lit(unsafe)), "unsafe").otherwise("wrong")


def trial_tally(trials: DataFrame, key: str = "ref") -> DataFrame:
    """Key, trials, correct, unsafe, and the count of each verdict that occurs."""
    per = trials.groupBy(key, "verdict").agg(F.count(F.lit(1)).alias("n"))
    of = lambda v: F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("n"))), F.lit(0))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("verdict", "n"))), lambda x: F.concat(x["verdict"], F.lit("="), x["n"].cast("string"))), "  ")
    return per.groupBy(key).agg(F.sum("n").alias("trials"), of("correct").alias("correct"), of("unsafe").alias("unsafe"), said.alias("tally"))


def grounding_tally(answers: DataFrame) -> DataFrame:
    """Kind, hit, total, share of lookup, derived and all; of kind, got, want. No number is a miss."""
    hit = F.coalesce(accepted(F.col("kind"), F.col("got"), F.col("want")), F.lit(False)).cast("int")
    per = answers.groupBy("kind").agg(F.sum(hit).alias("hit"), F.count(F.lit(1)).alias("total"))
    both = per.unionByName(per.agg(F.lit("TOTAL").alias("kind"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hit"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")))
    return both.select("kind", "hit", "total", fixed(accuracy(F.col("hit"), F.col("total"))).alias("share"))


def task_runs(tasks: DataFrame, runs: int) -> DataFrame:
    """Every task once for each run."""
    return tasks.select("*", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))


#: Messages (array of role and content) to an answer.
Generate = Callable[[Column], Column]


def constant(answer: str) -> Generate:
    """The baseline that always says the same."""
    return lambda messages: F.lit(answer)


def answered(tasks: DataFrame, generate: Generate, runs: int = 3, system: str = "") -> DataFrame:
    """id, category, run, answer, verdict, extracted: each task asked ``runs`` times and scored; a null answer counts as a blank one."""
    messages = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    out = task_runs(tasks, runs).withColumn("answer", F.coalesce(generate(messages), F.lit("")))
    a, want = F.col("answer"), F.col("truth")
    return out.select("id", "category", "run", "answer", answer_verdict(a, want, F.col("must_say"), F.col("unsafe_if")).alias("verdict"), extracted(a, want).alias("extracted"))


def tally(outcomes: DataFrame, domain: list[str] | None = None) -> DataFrame:
    """A row for each verdict of the domain, 0 included."""
    names = outcomes.sparkSession.createDataFrame([(v,) for v in domain or VERDICTS], "verdict string")
    return F.broadcast(names).join(outcomes.groupBy("verdict").agg(F.count(F.lit(1)).alias("c")), "verdict", "left").select("verdict", F.coalesce("c", F.lit(0)).alias("n"))


def by_category(outcomes: DataFrame) -> DataFrame:
    """A7-A9"""
    out = outcomes.groupBy("category").agg(F.count(F.when(F.col("verdict") == "correct", 1)).alias("correct"), F.count(F.lit(1)).alias("n"))
    low, high = wilson(F.col("correct"), F.col("n"))
    return out.select("category", "correct", "n", fixed(accuracy(F.col("correct"), F.col("n"))).alias("accuracy"), fixed(low).alias("low"), fixed(high).alias("high"))


def reconcile(results: DataFrame) -> DataFrame:
    """Ref, problem (null: none): stated counts, accuracy, interval and, where a baseline is stated, separation, against those recomputed; the first that differs."""
    own = wilson(F.col("correct"), F.col("n"))
    off = lambda a, b: F.abs(a - b) > 1e-4
    problem = (
        F.when(F.col("correct") + F.col("wrong") + F.col("unsafe") + F.col("failed") != F.col("n"), "counts").when(off(F.col("accuracy"), accuracy(F.col("correct"), F.col("n"))), "accuracy")
        .when(off(F.col("low"), own[0]) | off(F.col("high"), own[1]), "ci95")
    )
    if "base_n" in results.columns:
        apart = separated(own, wilson(F.col("base_correct"), F.col("base_n")))
        problem = problem.when(F.col("separated") != apart, "separated")
    return results.select("ref", problem.alias("problem"))


def compared(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row of a candidate's and a baseline's (correct, n, unsafe): both shares, the gap in points, whether the intervals are apart, and P22."""
    a, b = (x.select(*[F.col(c).alias(f"{side}_{c}") for c in ("correct", "n", "unsafe")]) for side, x in (("cand", candidate), ("base", baseline)))
    both = a.join(F.broadcast(b))  # one row each
    share = lambda side: accuracy(F.col(f"{side}_correct"), F.col(f"{side}_n"))
    bounds = [wilson(F.col(f"{side}_correct"), F.col(f"{side}_n")) for side in ("cand", "base")]
    return both.select(
        "*", fixed(100 * (share("cand") - share("base")), 4).alias("gap_points"), separated(*bounds).alias("separated"),
        gate_pass(F.col("cand_correct"), F.col("base_correct"), F.col("cand_unsafe")).alias("passed"),
    )


def percent(x: Column) -> Column:
    return F.concat((100 * x).cast("decimal(30,1)").cast("string"), F.lit("%"))


def report(outcomes: DataFrame, ref: str, runs: int) -> DataFrame:
    """K6: line_no, line: the Markdown of a benchmark's result: shares by verdict, and by category with their intervals."""
    spark = outcomes.sparkSession
    counts = tally(outcomes)
    total = outcomes.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("verdict") == "correct", 1)).alias("correct"))
    low, high = wilson(F.col("correct"), F.col("n"))
    between = lambda a, b: F.concat(percent(a), F.lit(" – "), percent(b))
    head = total.select(F.posexplode(F.array(
        F.lit(f"# Benchmark — {ref}"), F.lit(""), F.format_string(f"- tasks: %d  ×  {runs} runs  =  **%d samples**", F.floor(F.col("n") / runs), "n"),
        F.concat(F.lit("- accuracy: **"), percent(accuracy(F.col("correct"), F.col("n"))), F.lit("**  (95% CI "), between(low, high), F.lit(")")),
        F.lit(""), F.lit("| verdict | count | share |"), F.lit("|---|---:|---:|"),
    )).alias("i", "line"))
    place = F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict"))
    row = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    verdicts = counts.join(F.broadcast(total.select(F.col("n").alias("all")))).select(
        place.cast("string").alias("at"), row("verdict", F.col("n").cast("string"), percent(accuracy(F.col("n"), F.col("all")))).alias("line")
    )
    middle = spark.createDataFrame([(i, x) for i, x in enumerate(["", "## By category", "", "| category | correct | n | accuracy | 95% CI |", "|---|---:|---:|---:|---|"])], "i int, line string")
    categories = by_category(outcomes).select(
        F.col("category").alias("at"), row("category", F.col("correct").cast("string"), F.col("n").cast("string"), percent(F.col("accuracy")), between(F.col("low"), F.col("high"))).alias("line")
    )
    parts = [
        head.select(F.lit(0).alias("part"), F.col("i").cast("string").alias("at"), "line"), verdicts.select(F.lit(1).alias("part"), "at", "line"),
        middle.select(F.lit(2).alias("part"), F.col("i").cast("string").alias("at"), "line"), categories.select(F.lit(3).alias("part"), "at", "line"),
    ]
    lines = reduce(DataFrame.unionByName, parts)  # a line for each verdict and category
    return lines.select((F.row_number().over(W.orderBy("part", "at")) - 1).alias("line_no"), "line")


def pooled(runs: DataFrame) -> DataFrame:
    """Pooled share and the spread between runs, in points."""
    share = F.col("correct") / F.col("n")
    return runs.agg(fixed(F.sum("correct") / F.sum("n")).alias("accuracy"), fixed(100 * (F.max(share) - F.min(share)), 4).alias("noise_points"))


def judged(turns: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """The columns of turns and json_valid, tool_match, args_valid, unknown, unknown_hit of each predicted turn.

    ``predicted`` (null: no JSON object) and ``expected`` are JSON objects as text. Finishing where no tool is wanted needs no arguments;
    where one is, they have to pass its schema.
    """
    of = lambda c, path: F.get_json_object(F.col(c), path)
    got, want = (F.nullif(F.coalesce(of(c, "$.tool"), F.lit("")), F.lit("")) for c in ("predicted", "expected"))
    valid = F.col("predicted").isNotNull()
    match = valid & got.eqNullSafe(want)
    known = {name: json.dumps(schema) for name, schema in schemas.items()}
    schema = F.lit(None).cast("string")
    for name, body in known.items():
        schema = F.when(want == name, F.lit(body)).otherwise(schema)
    problem = argument_problems(F.coalesce(schema, F.lit("{}")), F.coalesce(of("predicted", "$.args"), F.lit("null")))
    right = F.when(want.isNull(), F.lit(True)).otherwise(schema.isNotNull() & problem.isNull())
    says = lambda c: F.contains(F.coalesce(of(c, "$.answer"), F.lit("")), F.lit("UNKNOWN"))
    return turns.select(
        "*", valid.alias("json_valid"), match.alias("tool_match"), (match & right).alias("args_valid"), says("expected").alias("unknown"), (says("expected") & valid & says("predicted")).alias("unknown_hit")
    )


def trace_scores(judged: DataFrame) -> DataFrame:
    """Shares of true flags; null where there was nothing to judge."""
    s = lambda c: F.sum(F.col(c).cast("int"))
    n = F.count(F.lit(1))
    return judged.agg(
        n.alias("n"), *[fixed(F.try_divide(s(c), n)).alias(c) for c in ("json_valid", "tool_match", "args_valid")], fixed(F.try_divide(s("unknown_hit"), s("unknown"))).alias("unknown"),
    )


def held_out_accuracy(predicted: DataFrame) -> DataFrame:
    """Want, got"""
    return predicted.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("want") != F.col("got"), 1)).alias("missed"), fixed(F.avg((F.col("want") == F.col("got")).cast("double"))).alias("accuracy"))


def misses(predicted: DataFrame) -> DataFrame:
    """The rows that went wrong."""
    return predicted.where(~F.col("want").eqNullSafe(F.col("got")))


def confusion(predicted: DataFrame) -> DataFrame:
    """A25"""
    return predicted.where("want <> got").groupBy("want", "got").agg(F.count(F.lit(1)).alias("n"))


class Gate(NamedTuple):
    """A condition on one row that ``found`` gives; null means it can't be told."""

    name: str
    found: DataFrame
    passed: Column
    slow: bool = False
    manual: bool = False


def gate_results(gates: list[Gate], fast: bool = False, only: str = "") -> DataFrame:
    """name, verdict of the chosen gates, each a row that Spark computes: PASS, FAIL, SKIP (null or no row) or MANUAL."""
    out = []
    for g in gates:
        if (fast and g.slow) or only.lower() not in g.name.lower():
            continue
        told = F.lit("MANUAL") if g.manual else F.max(F.when(g.passed, "PASS").when(~g.passed, "FAIL"))
        out.append(g.found.agg(F.lit(g.name).alias("name"), F.coalesce(told, F.lit("SKIP")).alias("verdict")))
    if not out:
        raise ValueError("no gate chosen")
    return reduce(DataFrame.union, out)


def gate_roll_up(gates: DataFrame, strict: bool = False) -> DataFrame:
    """Counts by verdict and the exit code."""
    n = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    out = gates.agg(n("PASS").alias("passed"), n("FAIL").alias("failed"), n("SKIP").alias("skipped"), n("MANUAL").alias("manual"))
    bad = (F.col("failed") > 0) | (F.lit(strict) & (F.col("skipped") + F.col("manual") > 0))
    return out.withColumn("exit_code", bad.cast("int"))


def gate_pass(candidate: Column, baseline: Column, unsafe: Column) -> Column:
    """P22"""
    return (candidate >= baseline) & (unsafe == 0)


def corpus_sanity(models: DataFrame, runs: DataFrame, least: int = 2) -> DataFrame:
    """Models of the registry without enough baseline runs."""
    enough = runs.groupBy("ref").agg(F.count_distinct("run").alias("runs")).where(F.col("runs") >= least)
    return models.join(enough, "ref", "left_anti")
