"""Links of pages."""

from __future__ import annotations

from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import slug
from loomspark.functions.udf import pandas

#: What no link may lead to.
EXCLUDE = r"(?i)(purchase|buy|cart|checkout|login|signin|register|payment)"


def hrefs(pages: DataFrame) -> DataFrame:
    """page_id, url, ord, href"""
    found = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", "url", F.posexplode(found).alias("ord", "href"))


def _target(url: str | None, href: str | None) -> tuple[str | None, bool]:
    try:
        target = urljoin(url or "", href or "")
        here, there = urlparse(url or ""), urlparse(target)
    except ValueError:
        return None, False
    return target, bool(there.netloc) and (here.scheme.lower(), here.netloc.lower()) == (there.scheme.lower(), there.netloc.lower())


@pandas("struct<target:string,same_host:boolean>")
def resolved(urls: pd.Series, hrefs_: pd.Series) -> pd.DataFrame:
    """the link as a browser on that page takes it (relative, rooted, `//host`, `..`, `?query`), and whether it stays on the host; built-ins don't resolve links."""
    return pd.DataFrame([_target(u, h) for u, h in zip(urls, hrefs_)], columns=["target", "same_host"])  # noqa: B905


def in_scope(links: DataFrame, follow: str, exclude: str = EXCLUDE) -> DataFrame:
    """page_id, url, ord, href, target. Hosts are compared whole, so a longer host that starts alike is out of scope."""
    href = F.regexp_replace("href", r"^\s+|\s+$", "")
    told = links.where((href != "") & ~F.regexp_like(href, F.lit(r"^(#|javascript:|mailto:)")))
    out = told.withColumn("_r", resolved("url", href)).where("_r.same_host").withColumn("target", F.col("_r.target")).drop("_r")
    wanted = F.regexp_like("target", F.lit(f"(?i){follow}")) | F.endswith(F.lower("target"), F.lit(".pdf"))
    return out.where(~F.regexp_like("target", F.lit(exclude)) & wanted)


def distinct_targets(scoped: DataFrame) -> DataFrame:
    """U4: target and where it appears first."""
    first = scoped.groupBy("target").agg(F.min(F.struct("page_id", "ord")).alias("at"))
    return first.select("target", F.col("at.page_id").alias("page_id"), F.col("at.ord").alias("ord"))


def targets(scoped: DataFrame, n: int = 40) -> DataFrame:
    """The first n distinct targets in order of appearance."""
    return distinct_targets(scoped).orderBy("page_id", "ord").limit(n)


def suffix(url: Column, content_type: Column | None = None) -> Column:
    """F35"""
    pdf = F.endswith(F.lower(url), F.lit(".pdf"))
    return F.when(pdf if content_type is None else pdf | F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("pdf")), ".pdf").otherwise(".html")


def manifest(pages: DataFrame) -> DataFrame:
    """The file is named after the path, 80 characters of it."""
    path = F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#;]*)", 1)
    name = F.coalesce(F.nullif(slug(path, 80), F.lit("")), F.lit("index"))
    kind = F.col("content_type") if "content_type" in pages.columns else None
    return pages.select("page_id", "url", F.concat(name, suffix(F.col("url"), kind)).alias("file"), F.octet_length("html").alias("bytes"), F.sha2("html", 256).alias("sha256"))
