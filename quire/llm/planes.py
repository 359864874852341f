"""Token ids in files of bit planes: blocks of ids, transposed, each plane compressed by zstandard.

A segment file holds whole documents: a header, a document index, a block index and the planes. Its table
row is (shard, segment, before, first_doc, n_docs, n_ids, payload), ``before`` the shard's ids ahead of it; Parquet, written by Spark into the shared
folder, carries the rows, so that writes are atomic and any executor can read them back.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.pieces import encoder
from quire.llm.tables import table
from quire.shared import materialize

MAGIC = b"QPL1"
BLOCK_IDS = 65_536
SEGMENT_IDS = 1 << 20
VOCABULARY, END_ID = "word_bpe_49k.json", 2
HEADER = struct.Struct("<4sIIQ")  # magic, planes' unit in bits, documents, ids
BLOCK = struct.Struct("<II")  # ids, planes
SEGMENT_SCHEMA = "shard int, segment int, before long, first_doc long, n_docs long, n_ids long, payload binary"


def planes_of(ids: np.ndarray, unit: int) -> list[bytes]:
    """The ids' planes, lowest first: bytes (unit 8) or bits (unit 1), up to the highest plane with a one."""
    lanes = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if unit == 8:
        out = [np.ascontiguousarray(lanes[:, i]) for i in range(4)]
    else:
        bits = np.unpackbits(lanes, axis=1, bitorder="little")
        out = [np.packbits(bits[:, i], bitorder="little") for i in range(32)]
    while len(out) > 1 and not out[-1].any():
        out.pop()
    return [p.tobytes() for p in out]


def ids_of(planes: list[bytes], n: int, unit: int) -> np.ndarray:
    if unit == 8:
        lanes = np.zeros((n, 4), dtype=np.uint8)
        for i, p in enumerate(planes):
            lanes[:, i] = np.frombuffer(p, dtype=np.uint8)
    else:
        bits = np.zeros((n, 32), dtype=np.uint8)
        for i, p in enumerate(planes):
            bits[:, i] = np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n, bitorder="little")
        lanes = np.packbits(bits, axis=1, bitorder="little")
    return lanes.reshape(-1).view("<u4")


def write_segment(doc_ids: list[int], lengths: list[int], ids: np.ndarray, unit: int = 8, block: int = BLOCK_IDS, level: int = 3) -> bytes:
    """Header; doc ids and lengths; for each block its id count and planes' sizes; then the planes."""
    pack = zstandard.ZstdCompressor(level=level).compress
    index, body = [], []
    for i in range(0, len(ids), block):
        part = ids[i : i + block]
        planes = [pack(p) for p in planes_of(part, unit)]
        index.append(BLOCK.pack(len(part), len(planes)) + np.array([len(p) for p in planes], dtype="<u4").tobytes())
        body += planes
    table_of = pack(np.array(doc_ids, dtype="<i8").tobytes() + np.array(lengths, dtype="<u8").tobytes())
    head = HEADER.pack(MAGIC, unit, len(doc_ids), len(ids))
    return head + struct.pack("<III", len(table_of), len(index), sum(map(len, index))) + table_of + b"".join(index) + b"".join(body)


@dataclass(frozen=True)
class Segment:
    doc_ids: np.ndarray
    lengths: np.ndarray
    ids: np.ndarray


def read_segment(payload: bytes) -> Segment:
    """Inverse of write_segment; ValueError on bytes that are no segment."""
    magic, unit, n_docs, n_ids = HEADER.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a segment of id planes")
    n_table, n_blocks, n_index = struct.unpack_from("<III", payload, HEADER.size)
    at = HEADER.size + 12
    unpack = zstandard.ZstdDecompressor().decompress
    raw = unpack(payload[at : at + n_table])
    index, at = at + n_table, at + n_table + n_index
    blocks = []
    for _ in range(n_blocks):
        n, n_planes = BLOCK.unpack_from(payload, index)
        sizes = np.frombuffer(payload, dtype="<u4", count=n_planes, offset=index + BLOCK.size)
        index += BLOCK.size + 4 * n_planes
        planes = []
        for size in sizes.tolist():
            planes.append(unpack(payload[at : at + size]))
            at += size
        blocks.append(ids_of(planes, n, unit))
    ids = np.concatenate(blocks) if blocks else np.zeros(0, dtype="<u4")
    if len(ids) != n_ids:
        raise ValueError("a segment has lost ids")
    return Segment(np.frombuffer(raw, dtype="<i8", count=n_docs), np.frombuffer(raw, dtype="<u8", offset=8 * n_docs), ids)


def write_ids(docs: DataFrame, path: str, end_id: int, partitions: int | None = None) -> DataFrame:
    """The segment table of ``docs(doc_id, text, ...)``: ids of whole texts with ``end_id`` after each
    document, in ascending doc_id order, segments of about SEGMENT_IDS ids that end with a document.

    One range shuffle of the texts; each task encodes as it streams over its sorted rows.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter("doc_id IS NOT NULL").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, shard, segment = encoder(path), np.array([end_id], dtype="<u4"), TaskContext.get().partitionId(), 0
        doc_ids, parts, size, before = [], [], 0, 0

        def close() -> pa.RecordBatch:
            payload = write_segment(doc_ids, [len(p) for p in parts], np.concatenate(parts))
            return pa.record_batch([pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([before], pa.int64()), pa.array(doc_ids[:1], pa.int64()), pa.array([len(doc_ids)], pa.int64()), pa.array([size], pa.int64()), pa.array([payload], pa.binary())], ["shard", "segment", "before", "first_doc", "n_docs", "n_ids", "payload"])

        for batch in batches:
            for i in range(0, len(batch), 256):
                some = batch.slice(i, 256)
                for doc_id, text in zip(some["doc_id"].to_pylist(), some["text"].to_pylist(), strict=True):
                    doc_ids.append(doc_id)
                    parts.append(np.concatenate([encode.ids(text).astype("<u4"), end]))
                    size += len(parts[-1])
                    if size >= SEGMENT_IDS:
                        yield close()
                        doc_ids, parts, size, segment, before = [], [], 0, segment + 1, before + size
        if doc_ids:
            yield close()

    return ordered.mapInArrow(write, SEGMENT_SCHEMA)


def read_ids(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit binary) from a segment table.

    A document's start is the ids of all before it: in its segment, in its shard (the segment's ``before``)
    and in the shards before. Only one count a shard is shuffled, and broadcast: there are as many shards as
    partitions were written, so a few bytes for each task of the job that wrote them.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, before, payload in zip(batch["shard"].to_pylist(), batch["before"].to_pylist(), batch["payload"], strict=True):
                found = read_segment(payload.as_py())
                n = len(found.doc_ids)
                lengths = found.lengths.astype(np.int64)
                ends = np.cumsum(lengths)
                bounds = np.concatenate([[0], ends * 4]).astype("<i4").tobytes()
                ids = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(found.ids.astype("<u4").tobytes())])
                yield pa.record_batch([pa.array([shard] * n, pa.int32()), pa.array(found.doc_ids), pa.array(before + ends - lengths), pa.array(lengths), ids], ["shard", "doc_id", "start_in", "n_tokens", "ids"])

    docs = segments.select("shard", "before", "payload").mapInArrow(read, "shard int, doc_id long, start_in long, n_tokens long, ids binary")
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("first"))
    return docs.join(F.broadcast(shards), "shard").select("doc_id", (F.col("first") + F.col("start_in")).alias("start"), "n_tokens", "ids")


def store_ids(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Write the ids of ``docs`` in the shared folder and read them back.

    Null or empty texts are the end id alone; rows without a doc_id have no place in the order and are left
    out; rows that repeat a doc_id stand beside each other by text; further columns are ignored; an empty
    table writes no segment and gives no row.
    """
    return read_ids(materialize(write_ids(docs, path, end_id), "planes"))


def op7_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_ids(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
