"""Text expressions: columns of built-in functions (those with lambdas are interpreted, the others compiled)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms that make a line part of an address block.
ADDRESS_MARKERS = ["cin:", "cin :", "regd. office", "regd.office", "kuthethoor", "mudapadav", "katipalla", "mangaluru", "karnataka"]
#: Extensions of images.
IMAGES = [".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp"]
#: Patterns of figures, dates, bare years, numbers in answers, and the period of a statement.
FIGURE = r"\(?-?\d[\d,.]*(?:\s\d{2}(?![\d,.]))?\)?"
DATE = r"\d\s*[.\-/]\s*\d{1,2}\s*[.\-/]\s*\d{2}"
YEAR = r"^\D*(?:1\D*9|2\D*0)\D*\d\D*\d\D*$"
ANSWER_NUMBER = r"-?\d[\d,]*\.?\d*"
PERIOD = r"(?i)(?=[QHNY][UAIE])(QUARTER|HALF YEAR|NINE MONTHS|YEAR)\s+(?:AND\s+\w+\s+)?ENDED\s+([A-Z]+\s+\d{1,2},?\s+\d{4}|\d{2}[.\-/]\d{2}[.\-/]\d{4})"


def strip(c: Column) -> Column:
    """Without white space at both ends, line breaks and Unicode spaces included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """lower-case runs of letters, digits and inner hyphens."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9][a-z0-9\-]*"), F.lit(0))


def router_tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def router_features(text: Column) -> Column:
    """words, pairs of neighbours, and the first word and pair marked as such. Pairs are made within one string, which needs no interpreted step."""
    t = router_tokens(text)
    n = F.size(t)
    none = F.array().cast("array<string>")
    joined = F.regexp_replace(F.array_join(t, " "), "([a-z0-9]+) (?=([a-z0-9]+))", "$1_$2 ")
    pairs = F.when(n > 1, F.slice(F.split(joined, " "), F.lit(1), n - 1)).otherwise(none)
    first = F.when(n > 0, F.array(F.concat(F.lit("@start:"), F.get(t, 0)))).otherwise(none)
    second = F.when(n > 1, F.array(F.concat(F.lit("@start2:"), F.get(t, 0), F.lit("_"), F.get(t, 1)))).otherwise(none)
    return F.concat(t, pairs, first, second)


def truncate(text: Column, n: int, suffix: str) -> Column:
    """O11"""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(suffix))).otherwise(text)


def slug(text: Column, n: int) -> Column:
    """F18"""
    return F.left(F.lower(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9]+", "-"), r"^-+|-+$", "")), F.lit(n))


def repaired_number(token: Column) -> Column:
    """a figure as printed or scanned, as a decimal; null for dashes, and beyond 36 digits.

    Whatever separates the last two digits is the decimal point; only parentheses around it make a figure negative.
    """
    t = F.regexp_replace(token, r"^\s+|\s+$", "")
    core = F.trim(F.regexp_replace(F.regexp_replace(t, r"^[()]+|[()]+$", ""), r"[^0-9.,\s-]", ""))
    digits = F.regexp_replace(core, r"[^0-9]", "")
    whole = digits.try_cast("decimal(36,0)")
    parted = F.regexp_like(core, F.lit(r"^-?[\d.,\s]*[\s.,]\d{2}$"))
    value = F.when(parted, whole.cast("decimal(38,2)") / 100).otherwise(whole).try_cast("decimal(38,2)")
    negative = t.startswith("(") & t.endswith(")")
    return F.when(~t.isin("-", "--", "—") & (digits != ""), F.when(negative, -value).otherwise(value))


def figures(line: Column) -> Column:
    """The tokens of a line that are figures: numbers of 12 digits at most, without dates and bare years."""
    few = lambda t: (F.length(t) <= 12) | F.regexp_like(t, F.lit(r"^(?:\D*\d){1,12}\D*$"))
    keep = lambda t: few(t) & ~F.regexp_like(t, F.lit(YEAR)) & ~F.regexp_like(t, F.lit(DATE))
    found = F.filter(F.regexp_extract_all(line, F.lit(FIGURE), F.lit(0)), keep)
    return F.when(~F.regexp_like(line, F.lit(r"\d")) | is_address(line), F.array().cast("array<string>")).otherwise(found)


def figure_cents(token: Column) -> Column:
    """F14 of a token of ``figures``, in cents: a hundredfold ``repaired_number`` in fewer steps, as such a token has no other characters."""
    digits = F.translate(token, "(),.- \t\n\x0b\f\r", "").cast("long")
    value = F.when(F.regexp_like(token, F.lit(r"[\s.,]\d{2}\)?$")), digits).otherwise(digits * 100)
    return F.when(token.startswith("(") & token.endswith(")"), -value).otherwise(value)


def is_address(line: Column) -> Column:
    """P7"""
    first = "".join(sorted({m[0] for m in ADDRESS_MARKERS}))
    return F.regexp_like(F.lower(line), F.lit(f"(?=[{first}])(?:{'|'.join(map(re.escape, ADDRESS_MARKERS))})"))


def numbers(answer: Column) -> Column:
    """F16: numbers of an answer, commas dropped."""
    found = F.regexp_extract_all(answer, F.lit(ANSWER_NUMBER), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(x, ",", "").try_cast("double"))


def period(text: Column) -> Column:
    """"" if none is stated."""
    return F.initcap(F.regexp_extract(text, PERIOD, 0))


def modality(files: Column) -> Column:
    """Text, image, pdf or mixed, of an array of file names; other kinds don't count."""
    kinds = F.transform(files, lambda f: F.lower(F.regexp_extract(f, r"(\.[^./]+)$", 1)))
    image = F.exists(kinds, lambda k: k.isin(*IMAGES))
    pdf = F.exists(kinds, lambda k: k == ".pdf")
    return F.when(image & pdf, "mixed").when(image, "image").when(pdf, "pdf").otherwise("text")


def est_ctx(text: Column, pdfs: Column | int = 0, others: Column | int = 0) -> Column:
    """a quarter of the characters, 512, 768 for each PDF and 1024 for each other attachment."""
    return (F.floor(F.length(text) / 4) + 512 + F.lit(768) * pdfs + F.lit(1024) * others).cast("long")


def line_kind(line: Column) -> Column:
    """of a line without white space around it."""
    return F.when(line.startswith("## "), "h2").when(line.startswith("# "), "h1").when(line.startswith("- ") | line.startswith("* "), "bullet").otherwise("text")


def bold_runs(line: Column) -> Column:
    """array of struct<run, bold>; what stands between pairs of ** is bold, empty runs go."""
    parts = F.split(F.regexp_replace(line, r"\*\*(.+?)\*\*", "\u0001$1\u0001"), "\u0001")
    runs = F.transform(parts, lambda x, i: F.struct(x.alias("run"), (i % 2 == 1).alias("bold")))
    return F.filter(runs, lambda r: r["run"] != "")


def iso_utc(ts: Column) -> Column:
    """of a time in UTC, without microseconds where there are none."""
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("+00:00"))


def html_escape(text: Column) -> Column:
    """F45"""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def comma_list(text: Column) -> Column:
    """F46"""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def duration(seconds: Column) -> Column:
    """hours and minutes, or minutes and seconds; -- unless something is left."""
    s = F.floor(F.when(seconds > 0, F.nanvl(seconds, F.lit(0.0)))).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours, minutes = F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long")
    long, short = F.concat(hours.cast("string"), F.lit("h "), two(minutes % 60), F.lit("m")), F.concat(minutes.cast("string"), F.lit("m "), two(s % 60), F.lit("s"))
    return F.when(seconds.isNull() | F.isnan(seconds) | (seconds <= 0), "--").when(hours > 0, long).otherwise(short)


def sections(text: Column) -> Column:
    """array of struct<section, body> at markdown headings; what comes before the first has section ""."""
    marked = F.regexp_replace(text, r"(?m)^#{1,6}[ \t]+(.+)$", "\u0001$1\u0002")
    parts = F.split(marked, "\u0001")
    return F.transform(
        parts,
        lambda p, i: F.when(i == 0, F.struct(F.lit("").alias("section"), p.alias("body"))).otherwise(
            F.struct(F.trim(F.split(p, "\u0002", 2)[0]).alias("section"), F.get(F.split(p, "\u0002", 2), 1).alias("body"))
        ),
    )


def packed_paragraphs(body: Column, size: int = 2000, carry: int = 300) -> Column:
    """Paragraphs packed into pieces of about ``size`` characters, each beginning with the last ``carry`` of the one before.

    A fold over the paragraphs (strictly sequential); a paragraph longer than ``size`` is a piece of its own.
    """
    body = strip(body)
    paragraphs = F.filter(F.split(body, r"\n\s*\n"), lambda p: F.length(strip(p)) > 0)
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, p: Column) -> Column:
        full = (F.length(acc["cur"]) + F.length(p) + 2 > size) & (acc["cur"] != "")
        joined = F.when(acc["cur"] == "", p).otherwise(F.concat(acc["cur"], F.lit("\n\n"), p))
        over = F.concat(F.right(acc["cur"], F.lit(carry)), F.lit("\n\n"), p)
        return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"), F.when(full, over).otherwise(joined).alias("cur"))

    packed = F.aggregate(paragraphs, zero, step, lambda a: F.when(a["cur"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"]))))
    return F.when(F.length(body) <= size, F.array(body)).otherwise(packed)
