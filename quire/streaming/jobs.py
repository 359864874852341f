"""Streaming forms: admission with state across batches, incremental text extraction, and a sink of named files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quire.operators.text import html_to_text, text_stats
from quire.operators.validate import stateless_code
from quire.sources.named import located, write_named_results

ADMITTED = "job_id long, seq long, name string, size double, error_code string, accepted boolean, running_bytes double"
DECIDED = ADMITTED.replace("job_id long", "job string")
PROVIDER, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TAKEN = pa.schema([("job", pa.large_string()), ("seq", pa.int64()), ("name", pa.large_string()), ("size", pa.float64()), ("code", pa.large_string())])
ROWS_OUT = 10_000
#: Jobs meet in so many groups; a stream's checkpoint holds only for the number it was started with.
BUCKETS = 1024


class Admission(StatefulProcessor):
    """A bucket's state: of each of its jobs, how many files it has admitted, and their bytes. Jobs share a call, for
    one costs as much as a thousand files do."""

    def __init__(self, max_files: int | None, max_total: float | None, expire_ms: int | None) -> None:
        self.max_files, self.max_total, self.expire_ms = max_files, max_total, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getMapState("totals", "job string", "n long, total double", self.expire_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for job, n, total in zip(initialState["job"], initialState["n"], initialState["total"], strict=True):
            self.totals.updateValue((job,), (int(n), float(total)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A batch's files of one bucket stand in columns, about 60 bytes a file; decisions follow job and seq, and leave in parts.
        files = pa.concat_tables([pa.Table.from_pandas(part, TAKEN, preserve_index=False) for part in rows])
        order = pc.sort_indices(files, [("job", "ascending"), ("seq", "ascending")])
        job, before, n, total = None, None, 0, 0.0
        for at in range(0, len(order), ROWS_OUT):
            some = files.take(order.slice(at, ROWS_OUT))
            codes, totals = [], []
            for its, size, code in zip(some["job"].to_pylist(), some["size"].to_pylist(), some["code"].to_pylist(), strict=True):
                if its != job:
                    self.keep(job, before, (n, total))
                    job, before = its, self.totals.getValue((its,))
                    n, total = before or (0, 0.0)
                if code is None:
                    code = "too-many-files" if self.max_files is not None and n >= self.max_files else "total-too-large" if self.max_total is not None and total + size > self.max_total else None
                    n, total = (n + 1, total + size) if code is None else (n, total)
                codes.append(code)
                totals.append(total)
            yield some.drop_columns(["code"]).to_pandas().assign(error_code=codes, accepted=[c is None for c in codes], running_bytes=totals)
        self.keep(job, before, (n, total))

    def keep(self, job: str | None, before: tuple | None, now: tuple) -> None:
        """State that is the same is written only to last longer."""
        if job is not None and (self.expire_ms is not None or now != tuple(before or (0, 0.0))):
            self.totals.updateValue((job,), now)

    def close(self) -> None:
        pass


def admit_stream(
    files: DataFrame,
    suffixes: list[str] | None = None,
    max_files: int | None = None,
    max_file: float | None = None,
    max_total: float | None = None,
    initial: DataFrame | None = None,
    expire_ms: int | None = None,
) -> DataFrame:
    """admit_files over a stream of ``files(job_id, seq, name, size)``: a job's count and bytes are kept from batch to
    batch, in RocksDB. Within a batch a job's files are taken by seq; earlier batches came first. Files without a
    job_id are one job.

    ``initial(job_id, n, total)`` is what jobs have admitted before the stream's first batch, a row a job. A job of
    which nothing comes for ``expire_ms`` is forgotten; such a stream looks for what has expired without end, so it
    must be stopped, also with ``availableNow``. The state needs RocksDB, so this session's later streams
    with state use it too; streams that were started before keep what their checkpoint names.
    """
    spark = files.sparkSession
    if "RocksDB" not in spark.conf.get(PROVIDER):
        spark.conf.set(PROVIDER, ROCKSDB)
    job = lambda df: df.withColumn("job", F.coalesce(F.col("job_id").cast("long").cast("string"), F.lit(""))).withColumn("bucket", F.pmod(F.xxhash64("job"), F.lit(BUCKETS)).cast("int"))
    coded = job(files).select("bucket", "job", F.col("seq").cast("long"), "name", F.col("size").cast("double"), stateless_code(suffixes, max_file).alias("code"))
    before = None if initial is None else job(initial).select("bucket", "job", F.col("n").cast("long"), F.col("total").cast("double")).groupBy("bucket")
    mode = "none" if expire_ms is None else "processingTime"
    decided = coded.groupBy("bucket").transformWithStateInPandas(Admission(max_files, max_total, expire_ms), DECIDED, "append", mode, before)
    return decided.select(F.nullif("job", F.lit("")).cast("long").alias("job_id"), *[c.split()[0] for c in ADMITTED.split(", ")[1:]])


def extract_stream(pages: DataFrame) -> DataFrame:
    """doc_id and the text statistics and preview of a stream (or table) of ``pages(page_id, html)``."""
    texts = html_to_text(pages.select(F.col("page_id").alias("doc_id"), "html"))
    return text_stats(texts.select("doc_id", "text")).select("doc_id", "characters", "words", "paragraphs", "preview")


def extract_results(pages: DataFrame) -> DataFrame:
    """name, text: the readable text of a stream (or table) of ``pages(page_id, html)`` as results ``page-<id>.txt``."""
    return html_to_text(pages).select(F.format_string("page-%d.txt", F.col("page_id")).alias("name"), "text")


def write_results_stream(results: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Every row of the stream ``results(name, text)`` as the file ``path/name``, each batch whole and once.

    A batch's files appear together, then a mark of its number. A batch that is run again after a failure is passed
    over if it has its mark, and else writes the same names again. A later batch's result replaces an earlier one of
    its name. The marks belong to ``checkpoint``: another checkpoint's batches are others.
    """
    system, root = located(checkpoint)
    marks = f"{root}/quire-written"

    def write(batch: DataFrame, number: int) -> None:
        mark = f"{marks}/{number}"
        if system.get_file_info(mark).type == fs.FileType.NotFound:
            write_named_results(batch, path, replace=True)
            system.create_dir(marks, recursive=True)
            system.open_output_stream(mark).close()

    stream = results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()
