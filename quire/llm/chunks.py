"""BPE encoding by content-defined chunks that documents share, and decoding."""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quire.llm.pieces import byte_alphabet, encoder
from quire.llm.tables import table

VOCABULARY = "byte_bpe_50k.json"
WINDOW = 16  # characters that a cut depends on
SHORTEST, LONGEST, MEAN_BITS = 256, 8192, 10
CACHE_BYTES = 48 << 20
GEAR = np.random.default_rng(20).integers(0, 2**32, 256, dtype=np.uint32)
# A position after which the encoder starts anew whatever stands before, and before which nothing
# depends on what follows: a character that isn't white space, then one blank, then another such character.
SAFE = re.compile(r"(?<=\S)(?=\x20\S)")


def cut(text: str) -> list[str]:
    """``text`` in chunks that end where a rolling hash of the last WINDOW characters has MEAN_BITS zero bits.

    A cut depends on characters near it alone, so a passage that documents share has the same cuts, and so
    the same chunks, in each of them. Chunks under SHORTEST join the next one; those over LONGEST are split.
    """
    if len(text) <= SHORTEST:
        return [text] if text else []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    hashed = GEAR[(codes ^ (codes >> 8)) & 0xFF]
    step = 1
    while step < WINDOW:  # hashed[i]: of the last 2 * step characters
        hashed[step:] = hashed[step:] + (hashed[:-step] << np.uint32(step))
        step *= 2
    marks = np.flatnonzero((hashed >> np.uint32(32 - MEAN_BITS)) == 0) + 1
    ends, last = [], 0
    for at in [*marks.tolist(), len(text)]:
        while at - last > LONGEST:
            last += LONGEST
            ends.append(last)
        if at - last >= SHORTEST or at == len(text):
            ends.append(at)
            last = at
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False) if a < b]


class ChunkEncoder:
    """Encodes texts chunk by chunk; a chunk that came before, in any document, costs one lookup.

    Chunks are kept with the ids of their middle, from the first to the last safe position; the newest
    CACHE_BYTES of them stay. At each join, the end of one chunk and the start of the next are encoded again
    together; the stretch is widened by whole chunks until both its ends are safe positions, where the
    encoding of the parts and of the whole agree exactly.
    """

    def __init__(self, path: str):
        self.encode = encoder(path)
        self.kept: OrderedDict[str, tuple[int, int, bytes]] = OrderedDict()
        self.bytes = self.reused = self.encoded = 0

    def chunk(self, chunk: str) -> tuple[int, int, bytes]:
        """First and last safe position (0 and 0 without one) and the packed ids between them."""
        found = self.kept.get(chunk)
        if found is not None:
            self.reused += 1
            self.kept.move_to_end(chunk)
            return found
        self.encoded += 1
        first = SAFE.search(chunk)
        if first is None:
            found = 0, 0, b""
        else:
            last = first.start()
            at = len(chunk)
            while (at := chunk.rfind(" ", last + 1, at)) > 0:
                if SAFE.match(chunk, at):
                    last = at
                    break
            found = first.start(), last, self.encode.packed(chunk[first.start() : last])
        self.kept[chunk] = found
        self.bytes += 4 * len(chunk) + 200
        while self.bytes > CACHE_BYTES:
            old, _ = self.kept.popitem(last=False)
            self.bytes -= 4 * len(old) + 200
        return found

    def packed(self, text: str) -> bytes:
        if any(s in text for s in self.encode.special):
            return self.encode.packed(text)
        out, pending = [], ""
        for chunk in cut(text):
            first, last, ids = self.chunk(chunk)
            if not first:
                pending += chunk
                continue
            out += self.encode.packed(pending + chunk[:first]), ids
            pending = chunk[last:]
        out.append(self.encode.packed(pending))
        return b"".join(out)

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), dtype="<u2" if self.encode.small else "<u4")


class Decoder:
    """Byte-level decoding as the library's decode(ids, skip_special_tokens=False)."""

    def __init__(self, path: str):
        tokenizer = encoder(path).tokenizer
        back = {c: bytes([b]) for b, c in byte_alphabet().items()}
        added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        self.bytes = [b""] * tokenizer.get_vocab_size()
        for token, i in tokenizer.get_vocab().items():
            self.bytes[i] = token.encode() if token in added or any(c not in back for c in token) else b"".join(map(back.__getitem__, token))

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def chunk_encoder(path: str) -> ChunkEncoder:
    """One a worker process, so that chunks are shared by all the documents that it meets."""
    return ChunkEncoder(path)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit binary) and the decoded text of every row.

    ``docs(doc_id, text, ...)``: whole texts; null and empty texts have no ids and decode to an empty text;
    repeated rows are encoded each; further columns are ignored; an empty table gives no row. No shuffle:
    the chunks' ids would be several times the text's bytes if they were joined back through one.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda batches: coded(batches, path, False), "doc_id long, n_tokens long, ids binary, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """As encode_documents, with SHA-256 digests of the ids in decimal and of the decoded text instead."""
    return docs.select("doc_id", "text").mapInArrow(lambda batches: coded(batches, path, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def coded(batches: Iterator[pa.RecordBatch], path: str, digest: bool) -> Iterator[pa.RecordBatch]:
    encode, decode = chunk_encoder(path), decoder(path)
    names = [str(i) for i in range(len(decode.bytes))]
    for batch in batches:
        for i in range(0, len(batch), 256):
            part = batch.slice(i, 256)
            ids = [encode.ids(t or "") for t in part["text"].to_pylist()]
            texts = [decode.decode(x) for x in ids]
            sizes = pa.array(map(len, ids), pa.int64())
            if digest:
                numbers = [sha256(",".join(map(names.__getitem__, x.tolist())).encode()).hexdigest() for x in ids]
                yield pa.record_batch([part["doc_id"], sizes, pa.array(numbers, pa.string()), pa.array([sha256(t.encode()).hexdigest() for t in texts], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.record_batch([part["doc_id"], sizes, pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])


def op5_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
