"""Hierarchical packing of documents into training sequences of several context sizes."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.pieces import encoder
from quire.llm.tables import lean, table

TIERS = (128, 256, 512, 1024)
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, ids binary"
SEQUENCE_BITS = 36


class Packer:
    """Packs one task's documents as they come, holding at most ``buffer`` remainders.

    A document's whole multiples of the largest tier are sequences of their own; the remainder is routed to
    the smallest tier that holds it. Windows of the largest tier are opened first, then ever smaller ones;
    each takes its longest piece and fills the gap with the largest pieces that fit from its own and the
    shorter tiers, and at last with the head of a piece that is cut. A window so filled has a tier's size
    exactly. What can't fill the smallest tier waits for later documents.
    """

    def __init__(self, tiers: tuple[int, ...], step_tokens: int, first_sequence: int, buffer: int = 4096):
        self.tiers, self.step_tokens, self.buffer = tuple(sorted(tiers)), step_tokens, buffer
        self.sequence = first_sequence
        self.waiting: list[tuple[int, int]] = []  # (length, key), ascending
        self.held: dict[int, tuple] = {}  # key -> (doc_id, start, ids, doc_tokens)
        self.keys = self.waiting_tokens = 0
        self.in_tier = dict.fromkeys(self.tiers, 0)
        self.first_sequence = first_sequence
        self.rows: list[tuple] = []

    def hold(self, piece: tuple) -> None:
        self.keys += 1
        self.held[self.keys] = piece
        insort(self.waiting, (len(piece[2]), self.keys))
        self.waiting_tokens += len(piece[2])

    def take(self, at: int) -> tuple:
        length, key = self.waiting.pop(at)
        self.waiting_tokens -= length
        return self.held.pop(key)

    def emit(self, pieces: list[tuple]) -> None:
        """A sequence; its step group is one of equal token counts among the sequences of its tier."""
        length = sum(len(p[2]) for p in pieces)
        tier = self.tiers[min(bisect_left(self.tiers, length), len(self.tiers) - 1)]
        nth, offset = self.in_tier[tier], 0
        self.in_tier[tier] += 1
        group = self.first_sequence + nth // max(1, self.step_tokens // tier) * len(self.tiers) + self.tiers.index(tier)
        for doc_id, start, ids, doc_tokens in pieces:
            self.rows.append((doc_id, start, len(ids), doc_tokens, self.sequence, offset, tier, group, ids.astype("<u4").tobytes()))
            offset += len(ids)
        self.sequence += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        whole, longest = len(ids) // self.tiers[-1] * self.tiers[-1], self.tiers[-1]
        for start in range(0, whole, longest):
            self.emit([(doc_id, start, ids[start : start + longest], len(ids))])
        if whole < len(ids):
            self.hold((doc_id, whole, ids[whole:].copy(), len(ids)))  # a view would keep the whole document
        if len(self.waiting) >= self.buffer:
            self.drain()

    def fill(self, size: int) -> None:
        """One window of exactly ``size``, opened with the longest waiting piece; needs that many waiting tokens."""
        window, gap = [], size
        while gap:
            at = bisect_right(self.waiting, (gap, self.keys + 1)) - 1
            if at >= 0:
                piece = self.take(at)
            else:  # all that wait are longer: the shortest is cut
                doc_id, start, ids, doc_tokens = self.take(0)
                piece = doc_id, start, ids[:gap], doc_tokens
                self.hold((doc_id, start + gap, ids[gap:], doc_tokens))
            window.append(piece)
            gap -= len(piece[2])
        self.emit(window)

    def drain(self) -> None:
        """Windows from the largest tier that holds pieces to the smallest, as long as tokens fill them."""
        for low, size in reversed(list(zip((0, *self.tiers), self.tiers, strict=False))):
            while self.waiting and self.waiting[-1][0] > low and self.waiting_tokens >= size:
                self.fill(size)
        while self.waiting_tokens >= self.tiers[0] and len(self.waiting) >= self.buffer:
            self.fill(self.tiers[0])

    def finish(self) -> None:
        """The task's last tokens, fewer than the smallest tier, go into windows of falling powers of two."""
        self.drain()
        while self.waiting_tokens:
            size = self.tiers[-1]
            while size > self.waiting_tokens:
                size //= 2
            self.fill(size)

    def rows_so_far(self) -> list[tuple]:
        out, self.rows = self.rows, []
        return out


def pack_documents(docs: DataFrame, path: str, end_id: int = END_ID, tiers: tuple[int, ...] = TIERS, step_tokens: int = 8192) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, tier, step_group and
    the piece's ids as little-endian unsigned 32-bit binary.

    ``docs(doc_id, text, ...)``: whole texts; a null or empty text is the end id alone; repeated rows and
    ids are packed each for itself; further columns are ignored; an empty table gives no row. Sequences have
    exactly a tier's size, but for a few at each task's end, which have a smaller power of two. Each task
    packs what it reads, so nothing is shuffled and memory is one batch and one buffer of remainders; sequence
    ids hold the task's number, so a task that is run again gives the same rows.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(tiers, step_tokens, TaskContext.get().partitionId() << SEQUENCE_BITS)
        encode, end = encoder(path), np.array([end_id], dtype="<u4")
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64()), ("ids", pa.binary())])

        def rows() -> pa.RecordBatch:
            found = packer.rows_so_far()
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*found), schema, strict=True)] if found else [pa.array([], f.type) for f in schema], schema)

        for part in batches:
            for i in range(0, len(part), 256):
                some = part.slice(i, 256)
                for doc_id, text in zip(some["doc_id"].to_pylist(), some["text"].to_pylist(), strict=True):
                    packer.add(doc_id, np.concatenate([encode.ids(text or ""), end]))
                yield rows()
        packer.finish()
        yield rows()

    return docs.select("doc_id", "text").mapInArrow(lean(pack, encodes=True), SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")
