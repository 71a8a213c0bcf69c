"""Inspection reports: parsing, derived facts and consistency rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.numeric import fixed, next_due


def parse(reports: DataFrame) -> DataFrame:
    """doc_id, years, t_min, grid, location, previous, current, loss, ord from the markdown of a report; both header forms."""
    text = F.col("text")
    years = F.regexp_extract(text, r"(?i)interval[^0-9\n]*([0-9]+(?:\.[0-9]+)?)\s*(?:years|yr)", 1).try_cast("double")
    t_min = F.regexp_extract(text, r"(?i)t-?min[^:\n]*:[^0-9\n]*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    rows = reports.select("doc_id", years.alias("years"), t_min.alias("t_min"), F.posexplode(F.split(text, "\n")).alias("ord", "line"))
    cells = F.transform(F.split(F.trim(F.col("line")), r"\|"), lambda x: F.trim(x))
    rows = rows.select("doc_id", "years", "t_min", "ord", cells.alias("c")).where((F.size("c") >= 7) & F.regexp_like(F.get("c", F.lit(1)), F.lit(r"^[A-Z]+\d+$")))
    number = lambda i: F.get("c", F.lit(i)).try_cast("double")
    out = rows.select("doc_id", "years", "t_min", "ord", F.get("c", F.lit(1)).alias("grid"), F.get("c", F.lit(2)).alias("location"), number(3).alias("previous"), number(4).alias("current"), number(5).alias("loss"))
    return out.where(F.col("previous").isNotNull() & F.col("current").isNotNull())


def rates(readings: DataFrame) -> DataFrame:
    """rate (of the stated loss, four digits) and life (four digits, from that rate; infinite if nothing is lost) of each grid."""
    out = readings.withColumn("rate", fixed(F.try_divide(F.col("loss"), F.col("years")), 4))
    life = F.try_divide(F.col("current") - F.col("t_min"), F.col("rate"))
    return out.withColumn("life", F.when(F.col("rate") > 0, fixed(F.when(F.col("rate") > 0, life), 4)).otherwise(F.lit(float("inf"))))


def facts(rated: DataFrame) -> DataFrame:
    """The governing grid (thinnest, first on a tie), the largest loss, and what follows.

    Readings that repeat an ord come in the order of ``place``, if there is such a column, else with the larger loss first.
    """
    place = ["place"] if "place" in rated.columns else ["grid", -F.col("loss"), "previous"]
    out = rated.groupBy("doc_id").agg(
        F.min_by(F.struct("grid", "previous", "current", "loss", "rate", "life", "t_min", "years"), F.struct("current", "ord", "life", *place)).alias("g"),
        F.max("loss").alias("max_loss"), F.max_by("grid", F.struct("loss", -F.col("ord"))).alias("max_loss_grid"), F.count(F.lit(1)).alias("grids"),
    )
    named = [F.col(f"g.{c}").alias(c) for c in ("previous", "current", "loss", "rate", "life", "t_min", "years")]
    return out.select("doc_id", F.col("g.grid").alias("governing"), *named, fixed(F.least(F.col("g.life") / 2, F.lit(10.0)), 4).alias("next_interval"), "max_loss", "max_loss_grid", "grids")


def _broken(rows: DataFrame, grid: str, rules: dict[str, Column]) -> DataFrame:
    """doc_id, rule, grid: a row for each rule that a row breaks, in one pass."""
    told = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(True)), F.lit(name)) for name, cond in rules.items()]))
    return rows.select("doc_id", F.explode(told).alias("rule"), F.col(grid).alias("grid"))


def violations(rated: DataFrame, derived: DataFrame) -> DataFrame:
    """doc_id, rule, grid of each breach: of a reading, or (with the governing grid) of a report. What is missing breaks a rule."""
    c = F.col
    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    of_readings = _broken(rated, "grid", {
        "loss mismatch": F.abs(c("previous") - c("current") - c("loss")) > 1e-9, "non-physical": (c("current") <= 0) | (c("previous") <= 0),
        "wall grew": c("current") > c("previous"), "grid life": ~usable(c("life")),
    })
    of_reports = _broken(derived, "governing", {"below t-min": c("current") <= c("t_min"), "life": ~usable(c("life")) | (c("life") <= 0), "interval": c("years") <= 0})
    return of_readings.unionByName(of_reports)


def confusable(readings: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Pairs of different values of one report that one tolerance would both accept; a band join as equality on neighbouring steps."""
    step = 2 * tolerance
    a = readings.select("doc_id", F.col("grid").alias("grid_a"), F.col("current").alias("a")).withColumn("_k", F.floor(F.col("a") / step))
    b = readings.select("doc_id", F.col("grid").alias("grid_b"), F.col("current").alias("b"))
    b = b.select("*", F.explode(F.array(*[F.floor(F.col("b") / step) + d for d in (-1, 0, 1)])).alias("_k"))
    near = (F.col("grid_a") < F.col("grid_b")) & (F.col("a") != F.col("b")) & (F.abs(F.col("a") - F.col("b")) <= tolerance)
    return a.join(b, ["doc_id", "_k"]).where(near).drop("_k")


def worse(a: str = "a", b: str = "b"):
    """The fact with less life; b on a tie."""
    return F.when(F.col(f"{a}.life") < F.col(f"{b}.life"), F.col(a)).otherwise(F.col(b))


#: The labelled lines of a report, and the columns they show.
HEAD = [
    ("Equipment tag", "tag"), ("Description", "description"), ("Unit", "unit"), ("Inspection code", "code"), ("Inspection date", "inspected"), ("Inspector", "inspector"),
    ("Method", "method"), ("Last inspection", "previous_date"), ("Design pressure / temperature", "design"), ("Material", "material"), ("t-min (retirement limit)", "t_min"),
]


def markdown(reports: DataFrame, derived: DataFrame, readings: DataFrame) -> DataFrame:
    """K5: doc_id, markdown: title, the labelled lines of which the report has the column, the table of readings, interval, governing grid and next due date.

    ``reports`` has doc_id, previous_date and inspected (dates) and any of the columns of ``HEAD``; thicknesses have one decimal.
    """
    one = lambda x: x.cast("decimal(30,1)").cast("string")
    cells = ["grid", "location", one(F.col("previous")), one(F.col("current")), one(F.col("loss"))]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    table = readings.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", row.alias("s")))), lambda x: x["s"]), "\n").alias("_rows"))
    day = lambda name: F.date_format(name, "yyyy-MM-dd")
    shown = {"inspected": day("inspected"), "previous_date": day("previous_date"), "t_min": F.concat(one(F.col("t_min")), F.lit(" mm"))}
    all_ = reports.join(derived.select("doc_id", "governing", "current", "t_min", "life", "years", "max_loss", "max_loss_grid"), "doc_id").join(table, "doc_id")
    head = [F.concat(F.lit(f"**{label}:** "), shown.get(name, F.col(name).cast("string"))) for label, name in HEAD if name in all_.columns]
    parts = [
        F.concat(F.lit("# INSPECTION REPORT — "), F.col("doc_id").cast("string")), F.concat_ws("\n", *head), F.lit("---"), F.lit("## Thickness readings (mm)"),
        F.concat(F.lit("| Grid | Location | "), day("previous_date"), F.lit(" | "), day("inspected"), F.lit(" | Loss |\n|---|---|---|---|---|\n"), "_rows"),
        F.concat(F.lit("Interval between surveys: "), F.col("years").cast("string"), F.lit(" years.")),
        F.concat(F.lit("Maximum loss: "), one(F.col("max_loss")), F.lit(" mm at grid "), "max_loss_grid"),
        F.concat(F.lit("Minimum measured thickness: **"), one(F.col("current")), F.lit(" mm at grid "), "governing", F.lit("**")),
        F.concat(F.lit("**Next due (provisional):** "), next_due(F.col("inspected"), F.col("life"))),
    ]
    return all_.select("doc_id", F.concat(F.concat_ws("\n\n", *parts), F.lit("\n")).alias("markdown"))
