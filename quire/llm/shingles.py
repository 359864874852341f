"""Word shingles of Arrow text columns as numpy arrays, without a Python object for a word.

Words are runs of characters other than blank, tab and line ends (0x09-0x0D), A-Z lower-cased. A word's hash
is a polynomial of its bytes modulo 2**64, of all words at once, byte by byte; a shingle mixes those of its words.
Besides the text that takes about eight bytes a byte of text, and sixty a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

WORDS = 5
CHUNK_BYTES = 1 << 19
CHUNK_DOCS = 1023
VALUE_BITS = 54
_rng = np.random.default_rng(42)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
BYTE[65:91] = BYTE[97:123]
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
BASE, LONG_WORD = np.uint64(0x9E3779B97F4A7C15), 64
TURN = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of the words that begin at ``starts``; words of more than LONG_WORD bytes are digested one by one."""
    out = np.zeros(len(starts), dtype=np.uint64)
    live = np.flatnonzero(sizes <= LONG_WORD)
    for k in range(LONG_WORD):
        live = live[sizes[live] > k]
        if not len(live):
            break
        out[live] = out[live] * BASE + BYTE[data[starts[live] + k]]
    for w in np.flatnonzero(sizes > LONG_WORD):
        word = data[starts[w] : starts[w] + sizes[w]].tobytes().lower()
        out[w] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
    return mix(out)


@dataclass(frozen=True)
class Sets:
    """The shingle sets of some documents: document i has values[bounds[i]:bounds[i + 1]], ascending."""

    values: np.ndarray
    bounds: np.ndarray

    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of at most CHUNK_DOCS documents and, unless one is longer, CHUNK_BYTES bytes."""
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(ends, ends[at] + CHUNK_BYTES, side="right")) - 1
        to = min(max(to, at + 1), at + CHUNK_DOCS, len(texts))
        yield texts.slice(at, to - at)
        at = to


def plain(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """As one array of strings with 32-bit offsets and no nulls (a null text is an empty one)."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    return texts.cast(pa.string()).fill_null("")


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Sets:
    """Of one slice."""
    n_docs = len(texts)
    buffers = texts.buffers()
    ends = np.frombuffer(buffers[1], dtype=np.int32)[texts.offset : texts.offset + n_docs + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[ends[0] : ends[-1]] if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    ends = ends - ends[0]
    if not len(data):
        return Sets(np.zeros(0, dtype=np.uint64), np.zeros(n_docs + 1, dtype=np.int64))
    blank = BLANK[data]
    first = ~blank
    first[1:] &= blank[:-1]
    joints = ends[1:-1][ends[1:-1] < len(data)]
    first[joints] = ~blank[joints]
    starts = np.flatnonzero(first)
    if not len(starts):
        return Sets(np.zeros(0, dtype=np.uint64), np.zeros(n_docs + 1, dtype=np.int64))
    seen = np.cumsum(~blank, dtype=np.int32)
    hashed = word_hashes(data, starts, np.diff(np.append(seen[starts] - 1, seen[-1])))
    del blank, first, seen
    doc = np.searchsorted(ends[1:], starts, side="right")
    counts = np.bincount(doc, minlength=n_docs)
    parts, owners = [], []
    if len(hashed) >= words:
        n = len(hashed) - words + 1
        rolled = np.zeros(n, dtype=np.uint64)
        for j in range(words):
            rolled = (rolled + hashed[j : j + n]) * TURN[j % len(TURN)]
        whole = doc[:n] == doc[words - 1 :]
        parts.append(mix(rolled[whole]))
        owners.append(doc[:n][whole])
    firsts = np.concatenate([[0], np.cumsum(counts)])
    for d in np.flatnonzero((counts > 0) & (counts < words)):
        value = np.uint64(counts[d])
        for h in hashed[firsts[d] : firsts[d + 1]]:
            value = mix(np.array([value ^ h], dtype=np.uint64))[0]
        parts.append(np.array([value], dtype=np.uint64))
        owners.append(np.array([d]))
    keys = np.concatenate([(o.astype(np.uint64) << np.uint64(VALUE_BITS)) | (p >> np.uint64(64 - VALUE_BITS)) for p, o in zip(parts, owners, strict=True)])
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])]
    bounds = np.searchsorted(keys >> np.uint64(VALUE_BITS), np.arange(n_docs + 1, dtype=np.uint64))
    return Sets(keys & np.uint64((1 << VALUE_BITS) - 1), bounds)


def reduced(op: np.ufunc, values: np.ndarray, bounds: np.ndarray, empty: int) -> np.ndarray:
    """``op`` over the values of each document; ``empty`` where it has none."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.full(len(bounds) - 1, empty, dtype=values.dtype)
    if len(full):
        out[full] = op.reduceat(values, bounds[:-1][full])
    return out
