"""Periodic runs of words: a harmonic grid of anchors, extended by longest common extensions over a difference cover."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quire.llm.tables import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A perfect difference set; every distance modulo PERIOD is the difference of two of its residues.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: A run has at least LEAST_LENGTH words and LEAST_POWER periods.
LEAST_LENGTH, LEAST_POWER = 6, 4
ANCHORS = 1 << 20

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def residue_shifts() -> np.ndarray:
    """[a, b]: the fewest words after which positions of residues a and b are both in the cover."""
    inside = np.isin(np.arange(PERIOD), COVER)
    at = np.arange(PERIOD)
    both = inside[(at[:, None, None] + at) % PERIOD] & inside[(at[None, :, None] + at) % PERIOD]
    return both.argmax(2)


SHIFTS = residue_shifts()


class Extensions:
    """Longest common extensions of pairs of positions in ``words``, whose last word must occur nowhere else.

    Only suffixes at positions of the cover are sorted: by their first PERIOD words, then by doubling, as the suffix
    PERIOD words on is in the cover too. Their common prefixes lie in a sparse table of range minima. A pair compares
    fewer than PERIOD words until both sides are in the cover, and one minimum tells the rest.
    """

    def __init__(self, words: np.ndarray) -> None:
        self.size = len(words)
        self.words = np.concatenate([words, np.full(2 * PERIOD, -1, words.dtype)])
        classes = [np.arange(r, self.size, PERIOD) for r in COVER]
        positions = np.concatenate(classes)
        ends = np.repeat(np.cumsum([len(c) for c in classes]), [len(c) for c in classes])
        self.first = np.zeros(PERIOD, np.int64)
        self.first[list(COVER)] = np.cumsum([0, *map(len, classes[:-1])])
        ranks = [self.by_first_words(positions)]
        step = 1
        while len(positions) and ranks[-1].max() + 1 < len(positions):
            after = np.arange(len(positions)) + step
            last = ranks[-1].astype(np.int64)
            key = last * (len(positions) + 1) + np.where(after < ends, last[np.minimum(after, len(positions) - 1)] + 1, 0)
            ranks.append(dense(np.argsort(key, kind="stable"), key))
            step *= 2
        self.rank = ranks[-1]
        order = np.empty(len(positions), np.int64)
        order[self.rank] = np.arange(len(positions))
        self.minima = [self.neighbours(positions, ranks, order)]
        while 1 << len(self.minima) < len(positions):
            half, low = 1 << len(self.minima) - 1, self.minima[-1]
            self.minima.append(np.minimum(low[:-half], low[half:]))

    def by_first_words(self, positions: np.ndarray) -> np.ndarray:
        """Ranks of the samples by their first PERIOD words, several packed into each key."""
        bits = max(1, int(self.words.max() + 1).bit_length())
        each = max(1, 62 // bits)
        keys = []
        for begin in range(0, PERIOD, each):
            key = np.zeros(len(positions), np.int64)
            for k in range(begin, min(begin + each, PERIOD)):
                key = key << bits | (self.words[positions + k].astype(np.int64) + 1)
            keys.append(key)
        return dense(np.lexsort(keys[::-1]), *keys)

    def neighbours(self, positions: np.ndarray, ranks: list[np.ndarray], order: np.ndarray) -> np.ndarray:
        """Common prefix of each sorted sample and the next, down the levels of the doubling."""
        x, y = order[:-1].copy(), order[1:].copy()
        found = np.zeros(len(x), np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            same = np.flatnonzero(ranks[level][x] == ranks[level][y])
            x[same] += 1 << level
            y[same] += 1 << level
            found[same] += PERIOD << level
        found += self.compare(positions[x], positions[y], np.full(len(x), PERIOD))
        return found.astype(np.int32)

    def compare(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words agree from i and j on, ``most`` of them at most."""
        found, live = np.zeros(len(i), np.int64), np.flatnonzero(most > 0)
        k = 0
        while len(live):
            live = live[self.words[i[live] + k] == self.words[j[live] + k]]
            k += 1
            found[live] = k
            live = live[most[live] > k]
        return found

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The extensions of positions i and j, each of them different."""
        shift = SHIFTS[i % PERIOD, j % PERIOD]
        found = self.compare(i, j, shift)
        far = np.flatnonzero(found == shift)
        x, y = i[far] + shift[far], j[far] + shift[far]
        a, b = (self.rank[self.first[p % PERIOD] + p // PERIOD] for p in (x, y))
        low, high = np.minimum(a, b).astype(np.int64), np.maximum(a, b).astype(np.int64)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            some = np.flatnonzero(level == k)
            found[far[some]] += np.minimum(self.minima[k][low[some]], self.minima[k][high[some] - (1 << k)])
        return found


def dense(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Ranks from 0 of rows that ``order`` sorts by ``keys``; equal rows have one rank."""
    new = np.zeros(len(order), np.int64)
    for key in keys:
        ranked = key[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    out = np.empty(len(order), np.int32)
    out[order] = np.cumsum(new)
    return out


def grid(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(anchor, period) of all documents, about ANCHORS at a time.

    The words of a run of period q that have an equal word q later are 3 * q in a row at least, so one of them is
    an anchor if these stand 3 * q apart: n / (3 * q) for each q, n * log(n) / 3 for all.
    """
    doc = np.repeat(np.arange(len(sizes)), sizes // LEAST_POWER)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(sizes // LEAST_POWER) - sizes // LEAST_POWER, sizes // LEAST_POWER) + 1
    gap = (LEAST_POWER - 1) * period
    count = (sizes[doc] - period + gap - 1) // gap
    done = np.cumsum(count)
    begin = 0
    while begin < len(doc):
        before = done[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(done, before + ANCHORS, "right")))
        some = slice(begin, end)
        row = np.repeat(np.arange(begin, end), count[some])
        k = np.arange(len(row)) - np.repeat(done[some] - count[some] - before, count[some])
        yield starts[doc[row]] + k * gap[row], period[row]
        begin = end


def runs_of(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of every run of ``documents``, arrays of word numbers from 0, by document,
    start and period. They are searched together, parted by words that occur once."""
    sizes = np.array([len(d) for d in documents], dtype=np.int64)
    above = max((int(d.max()) for d in documents if len(d)), default=-1) + 1
    starts = np.cumsum(sizes + 1) - sizes
    words = np.empty(int(sizes.sum()) + len(documents) + 1, np.int32)
    words[0] = above
    for k, d in enumerate(documents):
        words[starts[k] : starts[k] + len(d)] = d
        words[starts[k] + len(d)] = above + 1 + k
    anchors = [(at[same], q[same]) for at, q in grid(starts, sizes) for same in [words[at] == words[at + q]]]
    at, q = (np.concatenate([a[k] for a in anchors] or [np.zeros(0, np.int64)]) for k in (0, 1))
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    forward, last = Extensions(words), len(words) - 1
    backward = Extensions(words[::-1])
    found = [np.zeros((3, 0), np.int64)]
    for some in (slice(b, b + ANCHORS) for b in range(0, len(at), ANCHORS)):
        ahead = forward.of(at[some], at[some] + q[some])
        behind = backward.of(last - (at[some] - 1), last - (at[some] + q[some] - 1))
        length = ahead + behind + q[some]
        good = length >= np.maximum(LEAST_LENGTH, LEAST_POWER * q[some])
        found.append(np.stack([at[some][good] - behind[good], length[good], q[some][good]]))
    start, length, q = np.concatenate(found, 1)
    # A stretch found by a multiple of its smallest period is the same stretch.
    order = np.lexsort([q, length, start])
    start, length, q = start[order], length[order], q[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, q = start[new], length[new], q[new]
    order = np.lexsort([q, start])
    doc = np.searchsorted(starts, start[order], "right") - 1
    return doc, start[order] - starts[doc], length[order], q[order]


def looped(words: np.ndarray, doc_id: int | None) -> np.ndarray:
    """Of one document in ten by its doc_id's checksum, the words from some place on give way to a repeated stretch."""
    h = crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return words[np.where(i < a, i, a + (i - a) % p)]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period, exactly; the first by start and period of several."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def report(doc_id: int | None, words: np.ndarray, names: np.ndarray, runs: list[tuple[int, int, int]]) -> tuple:
    kept = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        kept[start + period] += 1
        kept[start + length] -= 1
    left = names[words[np.cumsum(kept[:-1]) == 0]]
    best = strongest(runs)
    facts = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return doc_id, len(runs), *facts, sha256(listed.encode()).hexdigest(), sha256(" ".join(left).encode()).hexdigest()


def find_runs(docs: DataFrame, change=lambda words, doc_id: words) -> DataFrame:
    """doc_id, n_runs, the strongest run (start, length, period, exponent_milli) and the digests of all runs and of
    the text without their repetitions, for every row of ``docs(doc_id, text, ...)``; ``change(words, doc_id)`` gives
    the word numbers that are searched.

    Whole texts, exact. One pass without a shuffle: the documents of a batch are searched together, a document of n
    words in time n * log(n) and about 300 bytes a word. Null, empty and blank texts have no run and the digests of
    empty strings; repeated rows are searched each for itself; a null doc_id counts as an empty decimal; further
    columns are ignored; an empty table gives an empty result.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ids, split = part["doc_id"].to_pylist(), [WORD.findall(t or "") for t in part["text"].to_pylist()]
            sizes = np.array([len(w) for w in split], dtype=np.int64)
            codes, names = pd.factorize(np.array([w for ws in split for w in ws], dtype=object))
            del split
            words = [change(w, d) for w, d in zip(np.split(codes.astype(np.int32), np.cumsum(sizes)[:-1]), ids, strict=True)] if ids else []
            doc, *facts = runs_of(words)
            found: list[list[tuple[int, int, int]]] = [[] for _ in ids]
            for d, *run in zip(doc.tolist(), *(f.tolist() for f in facts), strict=True):
                found[d].append(tuple(run))
            rows = [report(d, w, names, r) for d, w, r in zip(ids, words, found, strict=True)]
            types = [pa.int64()] * 6 + [pa.string()] * 2
            columns = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], columns)

    return docs.select("doc_id", "text").mapInArrow(search, SCHEMA)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_runs(table(spark, sf_dir, "documents"), looped)


def op12_sql() -> str:
    """The same rows by joining equal words of a document: quadratic in a text's length, for tables of moderate texts."""
    bits = "list_reduce([xor(s, x), 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    checksum = f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda s, x: {bits}), 4294967295)"
    return rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, coalesce({checksum}, 0) AS h FROM documents),
e AS (SELECT *, len(ws) AS n, (h // 10) % greatest(len(ws), 1) AS a FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM e),
g AS (SELECT *, unnest(range(n)) AS i FROM f),
w AS (SELECT doc_id, n, i, ws[CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END + 1] AS word FROM g),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // {LEAST_POWER}),
k AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
s AS (SELECT doc_id, min(i) AS start, count(*) + q AS length, q FROM k GROUP BY doc_id, q, island HAVING count(*) + q >= greatest({LEAST_LENGTH}, {LEAST_POWER} * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1),
l AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY 1),
o AS (SELECT DISTINCT w.doc_id, w.i FROM w JOIN r ON w.doc_id = r.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length),
c AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS kept FROM w LEFT JOIN o ON w.doc_id = o.doc_id AND w.i = o.i WHERE o.i IS NULL GROUP BY 1)
SELECT documents.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, start, length, period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM documents LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)"""
