"""One file a result: tasks stage files, and they are moved to their names when all tasks are done; a Spark data source does so by folders."""

from __future__ import annotations

import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from quire.shared import discard, materialize

FORMAT = "quire_named_files"
STAGING = "_staging"
MOVERS = 16
#: Of a task, where many move at once.
TASK_MOVERS = 4


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def checked(name: str | None) -> str:
    """``name``, if a file can have it and readers don't pass over it."""
    if not name or "/" in name or "\0" in name or name[0] in "._":
        raise ValueError(f"not a file name: {name!r}")
    return name


def staged(path: str, staging: str, batches: Iterator[pa.RecordBatch]) -> tuple[str, Iterator[pa.RecordBatch]]:
    """A folder of this attempt, and the batches, whose files are in it once they are passed on."""
    system, root = located(path)
    folder = f"{root}/{staging}/{uuid4().hex}"
    system.create_dir(folder, recursive=False)

    def written() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch["name"].to_pylist(), batch["text"].to_pylist(), strict=True):
                with system.open_output_stream(f"{folder}/{checked(name)}") as out:
                    out.write((text or "").encode())
            yield batch

    return folder, written()


@dataclass
class Staged(WriterCommitMessage):
    folder: str


class NamedFilesWriter(DataSourceArrowWriter):
    """A task writes into a folder of its attempt, so a failed or repeated attempt touches nothing else. ``commit``
    moves the files of the attempts that count, ``abort`` removes what was staged. The job's folder for them is there
    before its tasks; a task that still runs when it has been removed can't make it anew, and fails. With ``folders``
    an attempt's folder is moved as a whole, so the driver's work grows with the tasks and not with the files."""

    def __init__(self, path: str, staging: str, replace: bool, folders: bool = False) -> None:
        self.path, self.staging, self.replace, self.folders = path, staging, replace, folders

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        folder, batches = staged(self.path, self.staging, iterator)
        for _ in batches:
            pass
        return Staged(folder)

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = located(self.path)
        if self.folders:
            for m in filter(None, messages):
                system.move(m.folder, f"{root}/part-{m.folder.rsplit('/', 1)[1]}")
            return
        staged = [f for m in messages if m for f in system.get_file_info(fs.FileSelector(m.folder))]
        if not self.replace:
            there = {f.base_name for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File}
            if taken := sorted(there & {f.base_name for f in staged})[:5]:
                raise FileExistsError(f"there are files of these names: {', '.join(taken)}")
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(lambda f: system.move(f.path, f"{root}/{f.base_name}"), staged))

    def abort(self, messages: list[Staged | None]) -> None:
        clean(self.path, self.staging)


def clean(path: str, staging: str) -> None:
    """Remove a job's staging, whatever its last tasks still do there."""
    system, root = located(path)
    folder = f"{root}/{staging}"
    for attempt in range(5):
        if system.get_file_info(folder).type == fs.FileType.NotFound:
            return
        try:
            system.delete_dir(folder)
        except OSError:
            if attempt == 4:
                raise
            time.sleep(0.2)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"], self.options["staging"], self.options["replace"] == "true", self.options.get("folders") == "true")


def write_named_results(results: DataFrame, path: str, replace: bool = False) -> None:
    """Every row of ``results(name, text, ...)`` as the file ``path/name`` (UTF-8; null text: empty).

    All files or none appear: tasks stage theirs, and once all are done other tasks move them to their names, some at a
    time. ``results`` is worked out once; names are checked in the table of what was staged. A name that occurs twice,
    or is no file name (empty, with a slash, with a dot or underscore first), fails the job without any file; so does
    a name that is there already, unless ``replace``. ``path`` is a local or shared folder, or a URI that pyarrow
    opens. For millions of results take ``write_result_buckets``.
    """
    spark = results.sparkSession
    system, root = located(path)
    staging = f"{STAGING}-{uuid4().hex}"

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, batches = staged(path, staging, batches)
        for batch in batches:
            yield pa.record_batch([pa.array([folder] * len(batch), pa.string()), batch["name"].cast(pa.string())], ["folder", "name"])

    system.create_dir(f"{root}/{staging}", recursive=True)
    try:
        files = materialize(results.select("name", "text").mapInArrow(stage, "folder string, name string"), "staged")
        try:
            if twice := files.groupBy("name").count().filter("count > 1").select("name").limit(5).collect():
                raise ValueError(f"names that occur twice: {', '.join(r['name'] for r in twice)}")
            if not replace:
                there = list_files(spark, path).select("path")
                if taken := files.join(there, F.concat(F.lit(f"{root}/"), "name") == F.col("path"), "left_semi").orderBy("name").limit(5).collect():
                    raise FileExistsError(f"there are files of these names: {', '.join(r['name'] for r in taken)}")
            tasks = 4 * spark.sparkContext.defaultParallelism
            files.repartition(tasks).mapInArrow(lambda batches: moved(path, batches), "n long").write.format("noop").mode("overwrite").save()
        finally:
            discard(files)
    finally:
        clean(path, staging)


def moved(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many staged files (``folder``, ``name``) are at ``path/name`` now; what an earlier attempt moved stays."""
    system, root = located(path)

    def move(folder: str, name: str) -> None:
        try:
            system.move(f"{folder}/{name}", f"{root}/{name}")
        except OSError:
            here, to = system.get_file_info([f"{folder}/{name}", f"{root}/{name}"])
            if here.type != fs.FileType.NotFound or to.type != fs.FileType.File:
                raise

    with ThreadPoolExecutor(TASK_MOVERS) as pool:
        for batch in batches:
            list(pool.map(move, batch["folder"].to_pylist(), batch["name"].to_pylist()))
            yield pa.record_batch([pa.array([len(batch)], pa.int64())], ["n"])


def save(results: DataFrame, path: str, **options: str) -> None:
    """A job of ``NamedFilesWriter``, its staging made before and removed after it."""
    results.sparkSession.dataSource.register(NamedFiles)
    system, root = located(path)
    staging = f"{STAGING}-{uuid4().hex}"
    system.create_dir(f"{root}/{staging}", recursive=True)
    try:
        results.select("name", "text").write.format(FORMAT).options(staging=staging, **options).mode("append").save(path)
    finally:
        clean(path, staging)


FILES, CONTENTS = "path string, size long, modified timestamp, folder boolean", "path string, text string"
FILE_ROWS, READ_BYTES = 10_000, 16 << 20


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path (as ``located`` takes it), size and modified of the files under ``path``, listed by tasks: the folder itself by
    one, those in it by as many as there are. Names with a dot or underscore first are passed over, as readers do."""
    system, root = located(path)
    tasks = 4 * spark.sparkContext.defaultParallelism

    def rows(found: list[fs.FileInfo]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(found), FILE_ROWS):
            some = found[at : at + FILE_ROWS]
            columns = [f.path for f in some], [f.size for f in some], pa.array([f.mtime for f in some], pa.timestamp("us", "UTC")), [f.type == fs.FileType.Directory for f in some]
            yield pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), columns[2], pa.array(columns[3], pa.bool_())], ["path", "size", "modified", "folder"])

    def shown(folder: str) -> list[fs.FileInfo]:
        return [f for f in system.get_file_info(fs.FileSelector(folder)) if f.base_name[0] not in "._"]

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield from rows(shown(root))

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.compute.invert(batch["folder"]))
            folders = batch["path"].filter(batch["folder"]).to_pylist()
            while folders:
                found = shown(folders.pop())
                folders += [f.path for f in found if f.type == fs.FileType.Directory]
                yield from rows([f for f in found if f.type == fs.FileType.File])

    first = spark.range(0, 1, 1, 1).mapInArrow(top, FILES).repartition(tasks)
    return first.mapInArrow(below, FILES).drop("folder")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text (UTF-8) of the files under ``path``, dealt to tasks one by one."""
    system, _ = located(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, texts, size = [], [], 0
            for at in batch["path"].to_pylist():
                with system.open_input_stream(at) as file:
                    texts.append(file.read().decode())
                paths.append(at)
                size += len(texts[-1])
                if size > READ_BYTES:
                    yield pa.record_batch([paths, texts], ["path", "text"])
                    paths, texts, size = [], [], 0
            if paths:
                yield pa.record_batch([paths, texts], ["path", "text"])

    return list_files(spark, path).select("path").repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(read, CONTENTS)


def read_named_results(spark: SparkSession, path: str) -> DataFrame:
    """name, text of what ``write_named_results`` wrote."""
    return read_files(spark, path).select(F.regexp_extract("path", "[^/]*\\z", 0).alias("name"), "text")
