"""Readers and writers (S1-S9, S12, S13, K2, K3, K8, K10-K12, O4, P17, P23, P24). All but the small configuration files are read by Spark."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.functions.text import IMAGES, truncate
from loomspark.operators.tools import jailed
from loomspark.sources.scratch import hadoop_path

EXEMPLAR = "prompt string, task_type string"
METRIC = "t double, step long, total_steps long, loss double, grad_norm double, lr double, vram_gb double"


def markdown_folder(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id (the file's stem) and text of every ``*.md``."""
    df = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return df.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.md$", "").alias("doc_id"), F.col("value").alias("text"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 0, blank lines skipped) and value of one file, in file order.

    A large file is read in blocks; a line's number is its place in its block plus the lines of the blocks before, so no task holds the file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    lines = lines.where(F.regexp_like("value", F.lit(r"\S")))
    sizes = lines.groupBy("_block").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_block", (F.sum("n").over(W.orderBy("_block")) - F.col("n")).alias("_before"))  # a row for each block
    numbered = lines.withColumn("_r", F.row_number().over(W.partitionBy("_block").orderBy("_at")) - 1)
    return numbered.join(F.broadcast(before), "_block").select((F.col("_r") + F.col("_before")).alias("line_no"), "value")


def exemplars(spark: SparkSession, path: str) -> DataFrame:
    """Ord, prompt, task_type"""
    return numbered_lines(spark, path).select(F.col("line_no").alias("ord"), F.from_json("value", EXEMPLAR).alias("r")).select("ord", "r.*")


def traces(spark: SparkSession, path: str) -> DataFrame:
    """S3: trace_id, turn, role, text"""
    rows = numbered_lines(spark, path).select(F.col("line_no").alias("trace_id"), F.from_json("value", "messages array<struct<role:string,content:string>>").alias("r"))
    return rows.select("trace_id", F.posexplode("r.messages").alias("turn", "m")).select("trace_id", "turn", F.col("m.role").alias("role"), F.col("m.content").alias("text"))


MODEL = """ord int, id string, backend string, ref string, device string, vram_gb double, max_ctx int, capabilities array<string>, routes array<string>,
priority int, requires_tools array<string>"""


def registry(spark: SparkSession, models: str, profiles: str) -> tuple[DataFrame, DataFrame, str, str]:
    """The models of a YAML file in file order, the profiles of a folder (id and budget_gb), and the names of the profile and the fallback that the file asks for."""
    import yaml

    with open(models, encoding="utf-8") as f:
        spec = yaml.safe_load(f)
    texts = lambda m, key: [str(x) for x in m.get(key) or []]
    rows = [
        (i, m["id"], m.get("backend"), m.get("ref"), m.get("device", "cpu"), float(m.get("vram_gb", 0)), int(m.get("max_ctx", 8192)), texts(m, "capabilities"), texts(m, "routes"), int(m.get("priority", 100)), texts(m, "requires_tools"))
        for i, m in enumerate(spec["models"])
    ]
    found = []
    for name in sorted(os.listdir(profiles)):
        if name.endswith(".yaml"):
            with open(os.path.join(profiles, name), encoding="utf-8") as f:
                found.append((name.removesuffix(".yaml"), float(yaml.safe_load(f)["vram_budget_gb"])))
    if spec["profile"] not in [name for name, _ in found]:
        raise ValueError(f"no profile {spec['profile']!r}")
    return spark.createDataFrame(rows, MODEL), spark.createDataFrame(found, "id string, budget_gb double"), spec["profile"], spec["fallback"]


def settings(path: str, defaults: dict) -> dict:
    """Defaults if there is no file; unknown keys and hosts other than this machine are errors."""
    import yaml

    if not os.path.exists(path):
        return dict(defaults)
    with open(path, encoding="utf-8") as f:
        own = yaml.safe_load(f) or {}
    if not isinstance(own, dict):
        raise ValueError("settings must be a mapping")
    if unknown := set(own) - set(defaults):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    if (host := own.get("host", defaults.get("host", "127.0.0.1"))) not in ("127.0.0.1", "localhost", "::1"):
        raise ValueError(f"{host} is not this machine")
    return {**defaults, **own}


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """S6"""
    return spark.read.option("multiLine", True).json(path)


def jailed_file(spark: SparkSession, root: str, name: str, limit: int = 6000) -> DataFrame:
    """S12"""
    return spark.read.text(f"{root}/{jailed(name, root)}", wholetext=True).select(truncate(F.col("value"), limit, "\n[truncated]").alias("text"))


def page_text(pages: Iterable[Callable[[], str]], probe: int = 3, least: int = 200, most: int = 60) -> tuple[str, int, bool]:
    """The text of a document's first ``most`` pages (the feature), how many were read, and whether it is a scan: its first ``probe`` pages hold under ``least`` characters, and no more are read. A page that fails is empty."""
    out: list[str] = []
    for number, page in enumerate(pages):
        if number == most or (number == probe and sum(map(len, out)) < least):
            break
        try:
            out.append(page())
        except Exception:  # noqa: BLE001  whatever the reader of one page raises, the others are read
            out.append("")
    return "\n".join(out), len(out), sum(map(len, out[:probe])) < least


def paged_documents(spark: SparkSession, folder: str, suffix: str, reader: Callable[[bytes], Iterable[Callable[[], str]]]) -> DataFrame:
    """doc_id (the file's stem), text, pages, scanned of every file; ``reader`` is any library's way to a file's pages."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text, pages, scanned = page_text(reader(b.column("content")[i].as_py()))
                stem = b.column("path")[i].as_py().rsplit("/", 1)[-1].removesuffix(suffix)
                yield pa.RecordBatch.from_pylist([{"doc_id": stem, "text": text, "pages": pages, "scanned": scanned}])

    return files.mapInArrow(run, "doc_id string, text string, pages long, scanned boolean")


def write_text(spark: SparkSession, root: str, name: str, content: str, limit: int = 50_000) -> int:
    """K8: the first ``limit`` characters (the feature) as one file in the jail, through whatever store holds it; its size."""
    fs, path = hadoop_path(spark, f"{root}/{jailed(name, root)}")
    body = content[:limit].encode()
    stream = fs.create(path, True)
    try:
        stream.write(body)
    finally:
        stream.close()
    return len(body)


def nearby(spark: SparkSession, root: str, n: int = 20) -> DataFrame:
    """The first n file names; logs of the audit aren't shown."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path").where(~F.contains("path", F.lit("/.audit"))).orderBy("path").limit(n)


def attachments(spark: SparkSession, root: str, names: list[str] | None = None, most: int = 6 << 20) -> tuple[DataFrame, DataFrame]:
    """Path, length, content of the images that aren't too large, and path and problem of the others that were asked for.

    Content isn't read for what is left out. ``names`` (default: all) are relative to the root; what leaves it is a problem, not an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    image = F.regexp_like(F.lower("path"), F.lit("(" + "|".join(x.replace(".", r"\.") for x in IMAGES) + ")$"))
    shown = files.where(image)
    problems = []
    if names is not None:
        wanted, base = [], hadoop_path(spark, root)[0].makeQualified(hadoop_path(spark, root)[1]).toString()
        for name in names:
            try:
                wanted.append((name, f"{base}/{jailed(name, root)}"))
            except ValueError as e:
                problems.append((name, str(e)))
        asked = spark.createDataFrame(wanted, "name string, _path string").where(F.regexp_like(F.lower("name"), F.lit("(" + "|".join(x.replace(".", r"\.") for x in IMAGES) + ")$")))
        plain = F.regexp_replace("path", "^file:/+", "file:/")
        shown = shown.join(F.broadcast(asked.select("_path").distinct()), plain == F.regexp_replace("_path", "^file:/+", "file:/"), "left_semi")
        there = files.select(plain.alias("_path"))
        gone = asked.join(there, F.regexp_replace(asked["_path"], "^file:/+", "file:/") == there["_path"], "left_anti")
        missing = gone.select(F.col("name").alias("path"), F.lit("no such file").alias("problem"))
    else:
        missing = spark.createDataFrame([], "path string, problem string")
    large = shown.where(F.col("length") > most).select("path", F.format_string("%dB exceeds %dB cap", "length", F.lit(most)).alias("problem"))
    refused = spark.createDataFrame(problems, "path string, problem string")
    return shown.where(F.col("length") <= most).select("path", "length", "content"), refused.union(missing).union(large)


def run_folders(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Configurations, summaries (status; for the runs that have one) and metrics of every run folder, with run_id."""
    run = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1).alias("run_id")

    def whole(name: str, column: str) -> DataFrame:
        folder = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name)
        return folder.text(root, wholetext=True).select(run, F.col("value").alias(column))

    summaries = whole("summary.json", "summary").withColumn("status", F.get_json_object("summary", "$.status"))
    metrics = spark.read.schema(METRIC).option("recursiveFileLookup", True).option("pathGlobFilter", "metrics.jsonl").json(root).select(run, "*")
    return whole("config.json", "config"), summaries, metrics


def write_jsonl(df: DataFrame, path: str, drop: tuple[str, ...] = ("_family",)) -> None:
    """K2, K11"""
    df.drop(*drop).write.mode("append").json(path)


def write_document(df: DataFrame, path: str) -> None:
    """One JSON document for each row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def staged(paths: list[str], forbidden: tuple[str, ...] = (".env", ".git", "secrets")) -> list[str]:
    """Refuse to stage what must not leave."""
    if bad := [p for p in paths if any(part in forbidden for part in p.split("/"))]:
        raise ValueError(f"not to be staged: {bad}")
    return paths
