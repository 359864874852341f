"""Reading the tables and small helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_SPACE = 1_000_000
BATCH_BYTES, BATCH_SETTING = 1 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
READER_ROWS, READER_SETTING = 512, "spark.sql.parquet.columnarReaderBatchSize"


def small_batches(spark: SparkSession) -> None:
    """From now on batches of rows that this session sends to Python hold about BATCH_BYTES, unless its setting is
    smaller already. Batches of narrow rows are bounded by their number of rows before; those of long texts by this.

    What Parquet's reader holds of a text column at once is bounded by rows alone: READER_ROWS."""
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_SETTING))
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    if int(spark.conf.get(READER_SETTING)) > READER_ROWS:
        spark.conf.set(READER_SETTING, str(READER_ROWS))


def give_back() -> None:
    """What the worker's allocators hold on to goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def drop_encoders() -> None:
    """Forget the encoders that a worker keeps from task to task, if it has any."""
    pieces = sys.modules.get("quire.llm.pieces")
    if pieces and pieces.encoder.cache_info().currsize:
        pieces.encoder.cache_clear()
        give_back()


def lean(work: Callable[[Iterator], Iterator], encodes: bool = False) -> Callable[[Iterator], Iterator]:
    """``work``, after which the worker gives the memory that it has freed back to the system: workers are used again
    by later tasks, and what their allocators hold on to would count against the executor. Work that encodes nothing
    first drops the encoders of earlier tasks, which would else stay as long as the worker."""

    def run(batches: Iterator) -> Iterator:
        if not encodes:
            drop_encoders()
        yield from work(batches)
        give_back()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(df: DataFrame, key: str, bound: int, seed: int = 17) -> DataFrame:
    """About ``bound`` rows of ``df`` (all, if it has fewer), by a hash of ``key``.

    The same rows for the same table, whatever its partitioning. Only classifiers
    are fitted on it; nothing else may depend on a sample.
    """
    total = df.count()
    if total <= bound:
        return df
    share = max(1, bound * SAMPLE_SPACE // total)
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(SAMPLE_SPACE)) < share)


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model may learn from: crc32(doc_id as text) mod 5 is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0
