"""Where results go: ports that a deployment implements, a store on any file system that Spark reaches, manifests."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from captureq.sources.files import write_files, written_once

#: Tries of a start-up probe, seconds between them, and the ending of a manifest's name.
PROBE_TRIES, PROBE_PAUSE, MANIFEST = 5, 1.0, ".result.json"


class ArtifactStore(Protocol):
    """Takes finished artifacts."""

    def put(self, name: str, data: bytes) -> str:
        """Store and return the uri."""


class ResultSink(Protocol):
    """Takes the report of every finished task; a failure to do so is told, never raised."""

    def record(self, reports: DataFrame) -> str | None: ...


class WorkerRegistry(Protocol):
    """Names the workers that there should be."""

    def members(self) -> list[str]: ...


class PackageSigner(Protocol):
    """Signs a package's digest."""

    def sign(self, digest: str) -> bytes: ...


class HadoopStore:
    """Artifacts as files below a folder of any scheme that the session's Hadoop configuration knows (s3a, hdfs, file)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.folder = folder.rstrip("/")

    def _path(self, name: str = ""):
        p = self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return p.getFileSystem(self.conf), p

    def probe(self, tries: int = PROBE_TRIES, pause: float = PROBE_PAUSE, sleep: Callable[[float], None] = time.sleep) -> None:
        """Wait until the folder is there. Only its absence is waited for; any other failure is raised at once."""
        for k in range(tries):
            fs, p = self._path()
            if fs.exists(p):
                return
            if k + 1 < tries:
                sleep(pause)
        raise FileNotFoundError(self.folder)

    def put(self, name: str, data: bytes) -> str:
        fs, p = self._path(name)
        out = fs.create(p, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        return f"{self.folder}/{name}"

    def put_all(self, artifacts: DataFrame) -> None:
        """Store many artifacts (name, data binary) from the executors; no byte passes through the driver."""
        write_files(artifacts.select("name", F.lit(0).cast("long").alias("part"), "data"), self.folder)


def object_uri(bucket: Column, prefix: Column, name: Column) -> Column:
    """s3://bucket/prefix/name; without a prefix (null or empty) s3://bucket/name."""
    prefix = F.nullif(F.regexp_replace(prefix, r"^/+|/+$", ""), F.lit(""))
    return F.concat(F.lit("s3://"), bucket, F.lit("/"), F.coalesce(F.concat(prefix, F.lit("/")), F.lit("")), name)


class ManifestSink:
    """Each report as the file path/<filename>.result.json, written by executors (see `files.write_files`).

    reports: filename, report; a null report is an empty file. Reports of success and of failure alike; a file that is
    written again replaces the one before, so a repeated batch leaves one file a task."""

    def __init__(self, path: str):
        self.path = path

    def record(self, reports: DataFrame) -> str | None:
        rows = reports.select(F.concat("filename", F.lit(MANIFEST)).alias("name"), F.lit(0).cast("long").alias("part"), F.col("report").cast("binary").alias("data"))
        try:
            write_files(rows, self.path)
        except Exception as e:  # noqa: BLE001  a lost manifest must not fail the task it tells of
            return str(e)
        return None

    def batch(self, reports: DataFrame, batch_id: int) -> None:
        """For foreachBatch: a batch that the ledger below path knows is not written again. A failure is raised, since the
        stream repeats the batch."""
        rows = reports.select(F.concat("filename", F.lit(MANIFEST)).alias("name"), F.lit(0).cast("long").alias("part"), F.col("report").cast("binary").alias("data"))
        written_once(reports.sparkSession, self.path, batch_id, lambda: write_files(rows, self.path))


def signed(packages: DataFrame, signatures: DataFrame, key: str = "page_id") -> DataFrame:
    """packages with signature and error: signatures (key, signature, error) come from the signer as a table. One that
    had to be signed (require_signature) and was not has the error `signing`; others go unsigned."""
    told = signatures.select(key, "signature", F.col("error").alias("_e"))
    out = packages.join(told, key, "left")
    error = F.when(F.col("require_signature") & F.col("signature").isNull(), F.concat(F.lit("signing"), F.coalesce(F.concat(F.lit(": "), "_e"), F.lit(""))))
    return out.withColumn("error", error).drop("_e")


def regions(sources: DataFrame) -> DataFrame:
    """path, name, body: the parts of source texts between `#region name` and `#endregion` comment lines, without the
    white space that all their lines begin with; texts without any give no rows."""
    whole = r"(?s)((?://|#|--)[ \t]*#region[ \t]+[^\n]*\n.*?\n?[ \t]*(?://|#|--)[ \t]*#endregion)"
    each = sources.select("path", F.explode(F.regexp_extract_all("text", F.lit(whole), 1)).alias("r"))
    name = F.trim(F.regexp_extract("r", r"#region[ \t]+([^\n]*)", 1))
    body = F.regexp_extract("r", r"(?s)^[^\n]*\n(.*?)\n?[ \t]*(?://|#|--)[ \t]*#endregion$", 1)
    lines = F.split(body, "\n")
    least = F.array_min(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.length(F.regexp_extract(x, r"^([ \t]*)", 1))))
    cut = F.array_join(F.transform(lines, lambda x: F.substr(x, F.coalesce(least, F.lit(0)) + 1)), "\n")
    return each.select("path", name.alias("name"), cut.alias("body"))


def in_locale_order(df: DataFrame, column: str, collation: str = "UNICODE") -> DataFrame:
    """Rows in the order of a language rather than of code points."""
    return df.orderBy(F.collate(F.col(column), collation))
