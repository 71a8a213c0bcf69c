"""Statements: figures, the two-sum reconciliation, verdicts and markdown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import figure_cents, figures, is_address, period

LOOKBACK = 40
#: The words before totals; digits and white space within a line; figures of lines that aren't split, and those after ";" that are none
#: (over 12 digits, years, dates). Characters one by one are a table in a pattern, ranges and ``\d`` in a class are calls.
ANCHOR = r"(?is)^.*?total income(?:\s*\([^)]{0,10}\))?"
DIGITS = "0123456789"
SPACE = " \t\x0b\f\r"
LINE_FIGURE = rf"\(?-?\d[{DIGITS},.]*(?:[{SPACE}]\d{{2}}(?![{DIGITS},.]))?\)?"
NO_FIGURE = (
    rf";(?:(?=[^;\n]{{13}})(?:[^{DIGITS};\n]*+\d){{13}}[^;\n]*|[^{DIGITS};\n]*(?:1[^{DIGITS};\n]*9|2[^{DIGITS};\n]*0)(?:[^{DIGITS};\n]*+\d){{2}}[^{DIGITS};\n]*"
    rf"|(?=[^;.\n]*\.[^;.\n]*\.)[^;\n]*?\d[{SPACE}]*\.[{SPACE}]*\d{{1,2}}[{SPACE}]*\.[{SPACE}]*\d{{2}}[^;\n]*)(?![^;\n])"
)


def lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.select(F.col(key), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "value"))


def line_figures(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, line, ord, cents of each figure."""
    each = rows.select(key, "line", F.posexplode(figures(F.col("value"))).alias("ord", "token"))
    return each.select(key, "line", "ord", figure_cents(F.col("token")).alias("cents"))


def _line_totals(line: Column) -> Column:
    """Cents of every figure behind "total income"; a short parenthesis right behind the words is no figure. Null without the words."""
    tail = F.regexp_replace(line, ANCHOR, "")
    return F.when(F.regexp_like(line, F.lit("(?i)total income")), F.transform(figures(tail), figure_cents))


def totals(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Key, line, ord, total (cents): every figure behind "total income" in lines with two of them or more."""
    found = rows.select(key, "line", _line_totals(F.col("value")).alias("f")).where(F.size("f") >= 2)
    return found.select(key, "line", F.posexplode("f").alias("ord", "total"))


def two_sum(figs: DataFrame, sums: DataFrame, key: str = "doc_id", lookback: int = LOOKBACK) -> DataFrame:
    """Key, row, ord, total, a, b of every total with two figures or more in the lines before; a and b are null if no two add up to it.

    a is the largest figure with a + b = total, 0 < a <= total and 0 <= b <= a. The band becomes equality on blocks of ``lookback`` lines
    (a total's window touches two), and the complement is an equality on integer cents, so all joins are hash or sort-merge joins.
    ``sums`` has key, line, total and ord (0 if there is none).
    """
    blocks = figs.withColumn("_block", F.floor(F.col("line") / lookback))
    number = F.col("ord") if "ord" in sums.columns else F.lit(0)
    t = sums.select(key, F.col("line").alias("row"), number.alias("nth"), "total")
    band = t.select("*", F.explode(F.array(F.floor(F.col("row") / lookback) - 1, F.floor(F.col("row") / lookback))).alias("_block"))
    window = band.join(blocks, [key, "_block"]).where(F.col("line").between(F.col("row") - lookback, F.col("row") - 1))
    names = [key, "row", "nth", "total"]
    # one row for each value: which of equal figures it is makes no difference to the sum
    values = window.groupBy(*names, "cents").agg(F.count(F.lit(1)).alias("n"))
    checked = values.groupBy(*names).agg(F.sum("n").alias("n")).where("n >= 2").drop("n")
    a = values.where((F.col("cents") > 0) & (F.col("cents") <= F.col("total"))).select(*names, F.col("cents").alias("a"), (F.col("total") - F.col("cents")).alias("b"))
    b = values.select(*names, F.col("cents").alias("b"))
    best = a.join(b, [*names, "b"]).where(F.col("b").between(0, F.col("a"))).groupBy(*names).agg(F.max("a").alias("a"))
    out = checked.join(best, names, "left")
    return out.select(key, "row", F.col("nth").alias("ord"), "total", "a", (F.col("total") - F.col("a")).alias("b"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it occurs there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _with_digits(text: Column) -> Column:
    """Lines without digits emptied: they have no figures."""
    return F.regexp_replace(text, rf"(?md)^[^{DIGITS}\n]+$", "")


def _cents(text: Column) -> Column:
    """The cents of every figure of a text, as ``line_figures`` has them but of lines with an address too: lines stay lines, ";" stands before a figure
    and "=" before the figures of ``totals``. A few passes over the text at once take a fraction of what steps for each line and figure do.
    """
    marked = F.regexp_replace(F.replace(text, F.lit("="), F.lit(";")), rf"(?i)total income(?:[{SPACE}]*\([^)\n]{{0,10}}\))?", "$0=")
    found = F.regexp_replace(marked, rf"[^\n{DIGITS}(=\-]*(?:({LINE_FIGURE}|=)|[(\-])|[^\n{DIGITS}(=\-]+", ";$1")
    few = F.regexp_replace(found, NO_FIGURE, "")
    signed = F.regexp_replace(few, r";\(([^;\n]*)\)(?![^;\n])", ";~$1")
    out = F.regexp_replace(signed, rf"(;[^;=\n]++)(?<![{SPACE}.,]\d\d\)?)", "$100")
    for x in f".,() -{SPACE[1:]}":
        out = F.replace(out, F.lit(x), F.lit(""))
    return F.replace(out, F.lit("~"), F.lit("-"))


def _numbers(cents: Column) -> Column:
    return F.array_remove(F.split(F.replace(cents, F.lit("="), F.lit("")), ";"), "").cast("array<bigint>")


def _checks(text: Column, lookback: int = LOOKBACK) -> Column:
    """``two_sum`` of a text's lines within its row: an array with, for each total that is checked, whether two figures add up to it."""

    def adds_up(window: Column, total: Column) -> Column:
        # the larger summands whose complement is there too: by hashes, not by pairs
        both = F.array_intersect(window, F.transform(window, lambda x: total - x))
        return F.exists(both, lambda a: (a > 0) & (a <= total) & (total - a <= a))

    def of_line(sums: Column, i: Column, figs: Column) -> Column:
        window = _numbers(F.array_join(F.slice(figs, F.greatest(i - lookback, F.lit(0)) + 1, F.least(i, F.lit(lookback))), ""))
        return F.when(F.size(sums) >= 2, _let(window, lambda w: F.when(F.size(w) >= 2, F.transform(sums, lambda total: adds_up(w, total)))))

    def of_lines(figs: Column, sums: Column) -> Column:
        after = lambda x: _numbers(F.substr(x, F.instr(x, "=") + 1))
        return F.flatten(F.array_compact(F.transform(sums, lambda x, i: F.when(x.contains("="), _let(after(x), lambda s: of_line(s, i, figs))))))

    def without_addresses(each: Column, cents: Column) -> Column:
        none = F.lit("")
        figs = F.zip_with(each, cents, lambda x, c: F.when(is_address(x), none).otherwise(c))
        # what stands before the words doesn't count for totals
        return _let(figs, lambda f: of_lines(f, F.zip_with(each, cents, lambda x, c: F.when(is_address(F.regexp_replace(x, ANCHOR, "")), none).otherwise(c))))

    def of_text(kept: Column) -> Column:
        return _let(F.split(_cents(kept), "\n"), lambda c: F.when(is_address(kept), without_addresses(F.split(kept, "\n"), c)).otherwise(of_lines(c, c)))

    return _let(_with_digits(text), of_text)


def checked(docs: DataFrame) -> DataFrame:
    """The statements with chars, checks_run, checks_passed and verdict; one with under 1000 characters is taken for a scan and not checked."""
    text = F.coalesce("text", F.lit(""))
    # the text is in one row, so its checks need no join
    found = F.when(F.length(text) >= 1000, _checks(text)).otherwise(F.array().cast("array<boolean>"))
    out = docs.withColumns({"chars": F.length(text), "_checks": found})
    out = out.withColumns({"checks_run": F.size("_checks").cast("long"), "checks_passed": F.size(F.array_remove("_checks", False)).cast("long")})
    return out.withColumn("verdict", verdict(F.col("chars"), F.col("checks_passed"))).drop("_checks")


def reconciled(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, chars, checks_run, checks_passed, verdict of each statement, as ``checked``."""
    return checked(docs).select(key, "chars", "checks_run", "checks_passed", "verdict")


def verdict(chars: Column, facts: Column) -> Column:
    """P10"""
    return F.when(chars < 1000, "scanned").when(facts > 0, "text+facts").otherwise("text-only")


def roll_up(filings: DataFrame) -> DataFrame:
    """Of ``reconciled`` statements; a check that passes is a fact."""
    return filings.groupBy("verdict").agg(
        F.count(F.lit(1)).alias("n"), F.sum("checks_run").alias("checks_run"), F.sum("checks_passed").alias("facts"), F.count(F.when(F.col("checks_run") > 0, 1)).alias("checked")
    )


def markdown(docs: DataFrame, checks: DataFrame | None = None, title: str = "Financial Results", notes: tuple[str, ...] = (), key: str = "doc_id") -> DataFrame:
    """K4: title and period, where it comes from, how many checks passed, and the lines that aren't blank.

    Without ``checks`` (as of ``reconciled``) a statement is checked here, within its row; with them they are joined by key.
    """
    body = F.array_join(F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x != ""), "\n")
    when = F.coalesce(F.nullif(period(F.col("text")), F.lit("")), F.lit("period not stated"))
    passed = F.format_string("> totals (%d/%d identity checks passed).", "checks_passed", "checks_run")
    head = F.concat_ws("\n", F.concat(F.lit("> Source: "), F.coalesce("source", F.lit(""))), *[F.lit(f"> {x}") for x in notes], F.lit("> Figures machine-extracted and reconciled against the statement's own"), passed)
    both = checked(docs) if checks is None else docs.join(checks, key)
    return both.select(key, F.concat(F.lit(f"# {title} — "), when, F.lit("\n\n"), head, F.lit("\n\n"), body, F.lit("\n")).alias("markdown"))
