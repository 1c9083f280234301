"""Many files of given names from one DataFrame, written side by side by executors.

Rows are (name, part, data) or, for packages, (name, entry, part, data). Rows of a name meet in one task in the order of
their parts and stream into its file, whatever its size. A file is written under a temporary name and renamed once it is
whole, so that a repeated or speculative task leaves one whole file and the driver moves no byte; a name that is written
again is replaced. Paths are of the schemes that pyarrow knows (file, s3, hdfs, gs) or local ones."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import json
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT, TEMPORARY, DONE = "captureq_files", "_temporary", "_SUCCESS"
#: The entry of a package that states the others, the one that is not deflated.
STATED, STORED = "datapackage.json", "archive/data.warc.gz"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one in spark.checkpoint.dir, deleted when the driver ends. Where none is configured a
    temporary one is set in local mode; on a cluster that is an error, since executors would each write to their own disk."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="captureq-"))
        found = sc.getCheckpointDir()
    path = f"{found.rstrip('/')}/captureq-{uuid.uuid4().hex}-{name}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone at exit
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: df as Parquet in the shared folder, read back."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _safe(name: str | None) -> str:
    if not name or name.startswith("/") or any(p in ("", ".", "..") for p in name.split("/")):
        raise ValueError(f"no name for a file: {name!r}")
    return name


class _Plain:
    """A file that is the rows' data, one after the other."""

    def __init__(self, out):
        self.out = out

    def add(self, entry: str | None, data: bytes) -> None:
        self.out.write(data)

    def close(self) -> None:
        self.out.close()


class _Package:
    """A ZIP of entries. The entry STATED is a JSON text that gets the hash and the size of all entries before it."""

    def __init__(self, out):
        self.out, self.zip, self.entry, self.now, self.told = out, zipfile.ZipFile(out, "w"), None, None, {}

    def _end(self) -> None:
        if self.now is not None:
            self.now.close()
            self.now = None

    def add(self, entry: str, data: bytes) -> None:
        if entry == STATED:
            stated = [{"name": e.rsplit("/", 1)[-1], "path": e, "hash": "sha256:" + h.hexdigest(), "bytes": n} for e, (h, n) in self.told.items()]
            body = json.loads(data)
            title = body.pop("title", None)
            data = (json.dumps({**body, "resources": stated, "title": title}, indent=2, ensure_ascii=False) + "\n").encode()
        if entry != self.entry or self.now is None:
            self._end()
            info = zipfile.ZipInfo(entry, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if entry == STORED else zipfile.ZIP_DEFLATED
            self.entry, self.now = entry, self.zip.open(info, "w", force_zip64=True)
            self.told[entry] = (hashlib.sha256(), 0)
        self.now.write(data)
        digest, n = self.told[entry]
        digest.update(data)
        self.told[entry] = (digest, n + len(data))

    def close(self) -> None:
        self._end()
        self.zip.close()
        self.out.close()


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, packages: bool):
        self.path, self.kind = path.rstrip("/"), _Package if packages else _Plain
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = opened(self.path)
        temporary = f"{root}/{TEMPORARY}-{self.job}/{uuid.uuid4().hex}"
        store.create_dir(temporary, recursive=True)
        name = file = None

        def finish() -> None:
            if file is None:
                return
            file.close()
            if "/" in name:
                store.create_dir(f"{root}/{name.rsplit('/', 1)[0]}", recursive=True)
            store.move(f"{temporary}/file", f"{root}/{name}")

        try:
            for batch in iterator:
                columns = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
                entries = columns.get("entry")
                for k in range(batch.num_rows):
                    of = columns["name"][k].as_py()
                    if of != name:
                        finish()
                        name, file = _safe(of), None
                        file = self.kind(store.open_output_stream(f"{temporary}/file"))
                    file.add(entries[k].as_py() if entries is not None else None, columns["data"][k].as_py() or b"")
            finish()
        finally:
            store.delete_dir(temporary)
        return WriterCommitMessage()

    def _clear(self, mark: bool) -> None:
        store, root = opened(self.path)
        folder = f"{root}/{TEMPORARY}-{self.job}"
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)
        if mark:
            store.create_dir(root, recursive=True)
            store.open_output_stream(f"{root}/{DONE}").close()

    def commit(self, messages) -> None:
        self._clear(True)

    def abort(self, messages) -> None:
        self._clear(False)


class FileSource(DataSource):
    """Options: path; packages (true: ZIP files of entries)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, part long, data binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options.get("packages", "false") == "true")


def write_files(rows: DataFrame, path: str, packages: bool = False) -> None:
    """Write each name's rows into one file below path, in the order of part (packages: given order of entries, then part;
    an entry's place is column `place`). Null data is empty; a name that is null, absolute or leaves the folder is an
    error, as are no rows none. One name's rows are one task's, streamed through it."""
    spark = rows.sparkSession
    spark.dataSource.register(FileSource)
    order = ["name", "place", "part"] if packages else ["name", "part"]
    dealt = rows.repartition("name").sortWithinPartitions(*order)
    dealt.select("name", *(["entry"] if packages else []), "part", "data").write.format(FORMAT).mode("append").option("packages", str(packages).lower()).save(path)


def written_once(spark: SparkSession, path: str, batch_id: int, write: Callable[[], None]) -> bool:
    """Run write() unless a batch of this id has been written below path; whether it ran. The ledger's mark follows the
    files, so that a batch that failed midway is written again, over the same names."""
    store, root = opened(path.rstrip("/"))
    mark = f"{root}/_batches/{batch_id}"
    if store.get_file_info(mark).type == fs.FileType.File:
        return False
    write()
    store.create_dir(f"{root}/_batches", recursive=True)
    store.open_output_stream(mark).close()
    return True


def read_ranges(places: DataFrame, path: str) -> DataFrame:
    """places (name, offset, length, further columns) with data binary: those bytes of the files below path."""
    root_path = path.rstrip("/")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(root_path)
        name = file = None
        for batch in parts:
            at = {c: batch.column(k).to_pylist() for k, c in enumerate(batch.schema.names) if c in ("name", "offset", "length")}
            data = []
            for of, offset, length in zip(at["name"], at["offset"], at["length"], strict=True):
                if of != name:
                    if file is not None:
                        file.close()
                    name, file = of, store.open_input_file(f"{root}/{_safe(of)}")
                file.seek(offset)
                data.append(file.read(length))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], names=[*batch.schema.names, "data"])
        if file is not None:
            file.close()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in places.schema.fields)
    return places.sortWithinPartitions("name", F.col("offset")).mapInArrow(run, f"{kinds}, data binary")
