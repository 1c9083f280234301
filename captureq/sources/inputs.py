"""Request inputs: batch lists, behaviour folders, index files and configuration."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_entries(data: object) -> list[tuple[list[str], str]]:
    """(labels, url) of a batch list; the first bad entry fails all; numbers and booleans become text; none is []."""
    if data is None:
        return []
    if not isinstance(data, list):
        raise ValueError("expected a list of entries")
    out = []
    for i, e in enumerate(data):
        if not isinstance(e, dict) or not isinstance(e.get("url"), str) or not isinstance(e.get("labels"), list):
            raise ValueError(f"entry {i}: needs labels (a list) and url (a text)")
        labels = []
        for k, x in enumerate(e["labels"]):
            if isinstance(x, bool):
                x = "true" if x else "false"
            if not isinstance(x, (str, int, float)):
                raise ValueError(f"entry {i}: label {k} is no scalar")
            labels.append(str(x))
        out.append((labels, e["url"]))
    return out


def batch_source(spark: SparkSession, content: str, limit: int | None = None) -> DataFrame:
    """A batch file (YAML where that library is present, else JSON) as rows idx, labels, url, the first `limit` of them."""
    try:
        import yaml

        data = yaml.safe_load(content)
    except ImportError:
        data = json.loads(content) if content.strip() else None
    rows = [(i, labels, url) for i, (labels, url) in enumerate(parse_entries(data))]
    return spark.createDataFrame(rows if limit is None else rows[: max(limit, 0)], "idx int, labels array<string>, url string")


def behavior_folder(spark: SparkSession, root: str, version: str) -> DataFrame:
    """host, ord, behavior, source of every script one folder below root/version; loose and other files are skipped."""
    path = f"{root.rstrip('/')}/{version}"
    if not root.startswith(("hdfs:", "s3", "viewfs:")) and not os.path.isdir(path):
        return spark.createDataFrame([], "host string, ord int, behavior string, source string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.js").load(path)
    parts = F.split("path", "/")
    rows = files.select(F.element_at(parts, -2).alias("host"), F.element_at(parts, -1).alias("behavior"), F.col("content").cast("string").alias("source"), F.element_at(parts, -3).alias("v"))
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("host").orderBy("behavior"))
    return rows.filter(F.col("v") == version).select("host", order.cast("int").alias("ord"), "behavior", "source")


def read_cdxj(spark: SparkSession, path: str) -> DataFrame:
    """surt, ts and the entry's fields of every non-empty index line."""
    schema = "url string, mime string, status string, digest string, length string, offset string, filename string"
    lines = spark.read.text(path).filter("length(value) > 0")
    brace = F.instr("value", "{")
    head = F.split(F.substring(F.col("value"), F.lit(1), brace - 1), " ")
    return lines.select(head[0].alias("surt"), head[1].alias("ts"), F.from_json(F.expr("substring(value, instr(value, '{'))"), schema).alias("e")).select("surt", "ts", "e.*")


def resolve(flag: object, env: Mapping[str, str], name: str, default: object) -> object:
    """Flag over environment over default; a list default splits the environment's text at commas."""
    if flag is not None:
        return flag
    if name not in env:
        return default
    raw = env[name]
    if isinstance(default, bool):
        if raw in ("true", "1"):
            return True
        if raw in ("false", "0", ""):
            return False
        raise ValueError(f"{name}: not a boolean: {raw}")
    if isinstance(default, list):
        return [x.strip() for x in raw.split(",") if x.strip()]
    return type(default)(raw) if default is not None else raw


def write_results(results: DataFrame, sinks: list) -> list[tuple[str, str]]:
    """Hand every result to every sink in order; a failing sink does not stop the others, failures are returned by name."""
    failed = []
    cached = results.persist()
    try:
        for sink in sinks:
            try:
                sink(cached)
            except Exception as e:  # noqa: BLE001  a sink's failure is only reported
                failed.append((getattr(sink, "__name__", "sink"), str(e)))
    finally:
        cached.unpersist()
    return failed
