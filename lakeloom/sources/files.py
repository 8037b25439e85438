"""Files as rows: directory walk (SRC-5), appended lines by byte offset (STM-5), one file per document (SNK-3), and files read whole.

Folders are listed, log bytes read and documents written in Spark tasks through
``pyarrow.fs``, which reaches local and shared folders and the object stores that
it was built with.  The driver holds one row per log file (its offset) and no
listing, no content.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceStreamReader, DataSourceWriter, InputPartition,
                                    WriterCommitMessage)

from ..session import scratch_path

#: One task reads about so many bytes of a log file.
SPLIT_BYTES = 64 << 20
#: Bytes that are read at once to find the beginning of a line.
BACK_BYTES = 1 << 16
LISTING = ("name string, contentLength long, lastModified timestamp, creationTime timestamp, permissions string, "
           "isShortcut boolean, accountType string, isDirectory boolean")


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and plain path of a path or URI."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (pafs.LocalFileSystem(), path.rstrip("/")) if "://" not in path else pafs.FileSystem.from_uri(path.rstrip("/"))


def walk_paths(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Files and directories below ``root``, empty ones included (SRC-5).

    One row each with the listing's eight fields: ``name`` is relative to
    ``root``; fields that the store doesn't keep are null.  The folders found in
    one round are the rows of the next, each listed in a task, so a tree takes as
    many rounds as it is deep.  Not recursive, a folder's own entries are listed,
    its folders among them.  A folder that is not there gives no rows; hidden
    entries are listed like others.
    """
    folders = spark.createDataFrame([("",)], "folder string")
    found = None
    while True:
        level = folders.repartition(max(1, min(spark.sparkContext.defaultParallelism * 4, 200))).mapInArrow(_lister(root), LISTING)
        path = scratch_path(spark, f"walk-{uuid.uuid4().hex}")
        level.write.parquet(path)
        level = spark.read.schema(level.schema).parquet(path)
        found = level if found is None else found.unionByName(level)
        folders = level.where("isDirectory").select(F.col("name").alias("folder"))
        if not recursive or folders.isEmpty():
            return found


def _lister(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = store(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                selector = pafs.FileSelector(f"{top}/{folder}".rstrip("/"), allow_not_found=True)
                infos = [i for i in fs.get_file_info(selector) if i.type in (pafs.FileType.File, pafs.FileType.Directory)]
                n, none = len(infos), [None] * len(infos)
                if n:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([f"{folder}/{i.base_name}".lstrip("/") for i in infos], pa.string()),
                        pa.array([i.size if i.is_file else 0 for i in infos], pa.int64()),
                        pa.array([i.mtime for i in infos], pa.timestamp("us", "UTC")), pa.array(none, pa.timestamp("us", "UTC")), pa.array(none, pa.string()),
                        pa.array(none, pa.bool_()), pa.array(none, pa.string()), pa.array([not i.is_file for i in infos], pa.bool_())],
                        names=[f.split()[0] for f in LISTING.split(", ")])
    return run


# ---------------------------------------------------------------------------
# STM-5: lines appended to log files
# ---------------------------------------------------------------------------

@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


def complete_lines(f, start: int, end: int) -> Iterator[tuple[int, str]]:
    """(offset, text) of the lines whose line feed lies in ``[start, end)`` of an open file.

    Only the beginning of the first of them is looked for before ``start``.
    """
    f.seek(start)
    data = f.read(end - start)
    at = data.find(b"\n")
    if at < 0:
        return
    head, back = b"", start
    while back > 0 and b"\n" not in head:
        step = min(BACK_BYTES, back)
        back -= step
        f.seek(back)
        head = f.read(step) + head
    head = head[head.rfind(b"\n") + 1 :]
    offset = start - len(head)
    for line in (head + data[: data.rfind(b"\n")]).split(b"\n"):
        yield offset, line.removesuffix(b"\r").decode("utf-8", "replace")
        offset += len(line) + 1


class _LineReader(DataSourceStreamReader):
    def __init__(self, options):
        self.root, self.suffix = options["path"], options.get("suffix", "")
        self.split = int(options.get("splitBytes", SPLIT_BYTES))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, top = store(self.root)
        infos = fs.get_file_info(pafs.FileSelector(top, recursive=True, allow_not_found=True))
        return {i.path: i.size for i in infos if i.is_file and i.size and i.base_name.endswith(self.suffix) and not i.base_name.startswith((".", "_"))}

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        out = []
        for path, size in sorted(end.items()):
            before = start.get(path, 0)
            if size < before:  # the file was cut or written anew
                before = 0
            out += [ByteRange(path, at, min(at + self.split, size)) for at in range(before, size, self.split)]
        return out or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        if partition.path:
            fs, _ = store(self.root)
            with fs.open_input_file(partition.path) as f:
                for offset, line in complete_lines(f, partition.start, partition.end):
                    yield partition.path, offset, line

    def commit(self, end: dict) -> None:
        pass


class LineTail(DataSource):
    """Streaming source ``line_tail``: the lines appended to the files below ``path`` since the last run (STM-5).

    The offset is the number of bytes of each file, so a run reads the new bytes
    and the beginning of the line that they end.  A line comes when its line feed
    does; rows are (file, offset, line).  Options: ``suffix`` of file names,
    ``splitBytes`` of a task.  A file that has become shorter is read anew.
    """

    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return "file string, offset long, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _LineReader(self.options)


def tail_bytes(spark: SparkSession, folder: str, sink: str, checkpoint: str, suffix: str = "") -> DataFrame:
    """Append to ``sink`` (parquet) the lines that came to the files below ``folder`` since the last run."""
    spark.dataSource.register(LineTail)
    lines = spark.readStream.format("line_tail").option("path", folder).option("suffix", suffix).load()
    query = lines.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(lines.schema).parquet(sink)


# ---------------------------------------------------------------------------
# SNK-3: one file per document
# ---------------------------------------------------------------------------

@dataclass
class Exported(WriterCommitMessage):
    files: int = 0
    names: list[str] = field(default_factory=list)


def _remove(fs: pafs.FileSystem, folder: str) -> None:
    if fs.get_file_info(folder).type == pafs.FileType.Directory:
        fs.delete_dir(folder)


def _clear_target(fs: pafs.FileSystem, top: str, overwrite: bool) -> None:
    if overwrite:
        _remove(fs, top)
    fs.create_dir(top, recursive=True)


def _show(fs: pafs.FileSystem, own: str, top: str) -> None:
    """Move what is below ``own`` to its places below ``top``; done again, it moves what is left.

    A folder that ``top`` doesn't have yet moves as a whole, where a rename can't
    end in a folder that another task has shown meanwhile: so folders, which may
    take more room than the files in them, are not there twice.
    """
    whole = isinstance(fs, pafs.LocalFileSystem)
    for info in fs.get_file_info(pafs.FileSelector(own, recursive=not whole, allow_not_found=True)):
        target = f"{top}/{info.path[len(own) + 1 :]}"
        if info.is_file:
            fs.move(info.path, target)
        elif not whole:
            fs.create_dir(target, recursive=True)
        else:
            try:
                fs.move(info.path, target)
            except OSError:  # the folder is there and has entries
                fs.create_dir(target, recursive=True)
                _show(fs, info.path, target)


class _FileWriter(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.staged = options.get("staging")
        self.staging = self.staged or f"{store(self.path)[1]}.__export_{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Exported:
        fs, _ = store(self.path)
        own, done, folders = f"{self.staging}/{uuid.uuid4().hex}", 0, set()
        for row in rows:
            name = row["path"]
            if not name or os.path.isabs(name) or ".." in name.split("/"):
                raise ValueError(f"not a file name below the export: {name!r}")
            target = f"{own}/{name}"
            folder = os.path.dirname(target)
            if folder not in folders:
                fs.create_dir(folder, recursive=True)
                folders.add(folder)
            with fs.open_output_stream(target) as out:
                out.write(bytes(row["content"] or b""))
            done += 1
        return Exported(done, [own])

    def commit(self, messages: list) -> None:
        """Show the files of the attempts that Spark took, and of no others."""
        fs, top = store(self.path)
        taken = [own for message in messages if message and message.files for own in message.names]
        if self.staged:  # export_files moves them, in tasks
            fs.create_dir(self.staging, recursive=True)
            with fs.open_output_stream(f"{self.staging}/taken") as out:
                out.write("\n".join(taken).encode())
            return
        _clear_target(fs, top, self.overwrite)
        for own in taken:
            _show(fs, own, top)
        self._clear(fs)

    def abort(self, messages: list) -> None:
        self._clear(store(self.path)[0])

    def _clear(self, fs: pafs.FileSystem) -> None:
        _remove(fs, self.staging)


class FileExport(DataSource):
    """Batch sink ``file_export``: rows (path, content) as one file each below the option ``path`` (SNK-3).

    Tasks write into folders of their own beside the target; the commit moves the
    files of finished tasks into place, so a failed or repeated task leaves no
    half-written or doubled file, and a failed job none at all.
    """

    @classmethod
    def name(cls) -> str:
        return "file_export"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(self.options, overwrite)


def export_files(df: DataFrame, path: str, name_col: str, b64_col: str, overwrite: bool = True) -> None:
    """Write each row's base64 content to the file ``path``/``name_col`` (SNK-3).

    Names are relative; of equal names one file stays; null content is an empty
    file; bad base64 raises and nothing is written.  When all files are written,
    tasks move them into place, each those of one writing task; the driver holds
    one path for each of these.
    """
    spark = df.sparkSession
    spark.dataSource.register(FileExport)
    fs, top = store(path)
    staging = f"{top}.__export_{uuid.uuid4().hex}"
    rows = df.select(F.col(name_col).cast("string").alias("path"), F.to_binary(F.col(b64_col), F.lit("base64")).alias("content"))

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = store(path)
        for batch in batches:
            for own in batch.column(0).to_pylist():
                _show(fs, own, top)
            yield batch

    try:
        rows.write.format("file_export").mode("append").option("path", path).option("staging", staging).save()
        with fs.open_input_file(f"{staging}/taken") as f:
            taken = f.read().decode().split()
        _clear_target(fs, top, overwrite)
        if taken:
            spark.createDataFrame([(own,) for own in taken], "own string").repartition(len(taken)).mapInArrow(move, "own string").collect()
    finally:
        _remove(fs, staging)


# ---------------------------------------------------------------------------
# SRC-4, SRC-6: many small files
# ---------------------------------------------------------------------------

#: A task reads about so many files or bytes, and hands on so many bytes at a time.
TASK_FILES, TASK_BYTES, CALL_BYTES = 5_000, 128 << 20, 8 << 20


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """Rows (path, content): every file below ``root`` whole, but hidden ones (a name or folder with ``.`` or ``_`` in front).

    Folders are listed and files read in tasks, so many small files cost the
    driver nothing.  A store that pyarrow can't reach is read by Spark.
    """
    try:
        store(root)
    except (pa.ArrowInvalid, NotImplementedError):
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    found = walk_paths(spark, root).where("not isDirectory").select("name", "contentLength").where("name not rlike '(^|/)([.]|_[^/=]*(/|$))'")
    files, size = found.agg(F.count("*"), F.coalesce(F.sum("contentLength"), F.lit(0))).first()
    tasks = max(1, min(files, spark.sparkContext.defaultParallelism), files // TASK_FILES, size // TASK_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = store(root)
        out = lambda paths, contents: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])
        for batch in batches:
            paths, contents, held = [], [], 0
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{top}/{name}", buffer_size=0) as f:
                    contents.append(f.read())
                paths.append(f"{root.rstrip('/')}/{name}")
                held += len(contents[-1])
                if held >= CALL_BYTES:
                    yield out(paths, contents)
                    paths, contents, held = [], [], 0
            if paths:
                yield out(paths, contents)

    return found.select("name").repartition(tasks).mapInArrow(run, "path string, content binary")
