"""Near duplicates: chosen-path set similarity join over minwise tokens of word shingles.

Each tree sends a document to the node of the minwise token that the tree's root picks. Nodes of a few
documents are compared exhaustively. Larger ones compare each member with three leaders of the node, and branch: the
node picks further minwise functions by its own path, and its members go on to the children that those give.
At most two candidates a document that the sketches support are confirmed on full shingle sets.

The trees only join most groups early. What they leave is found exactly: a prefix filter over every set, its
shingles in one global order, rarest first, gives all pairs between different components that can still be
linked, and these are confirmed as well. Crowds that share a shingle are compared where they stand, by parity
bitmaps that bound what two sets have in common, so that only pairs that can be links become rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.components import components
from quire.llm.shingles import VALUE_BITS, Sets, mix, plain, reduced, shingle_sets, slices
from quire.llm.tables import bounded_sample, lean, table
from quire.shared import discard, materialize

FUNCTIONS = 64
TREES = 12
SMALL_NODE = 64
DEPTH = 2
SUPPORT = 40  # equal minwise tokens of FUNCTIONS that a tree's candidate needs; a link has 48 in the mean, 3.5 deviation
LEADERS = ("x", "y", "z")
SURE = 50  # what most links reach, and few other pairs
PERCENT = 75
BROADCAST_IDS = 200_000
SAMPLE_DOCS, COMMON_SHINGLES, LEVELS = 10_000, 500_000, 1023
SMALL_GROUP, CELLS, PAIRS = 32, 131_072, 16_384
NARROWEST, WIDEST = 512, 4096  # bits of parity bitmaps
CROWD_BLOCK = 4096  # members of one shingle that meet in one group
HOT_LEVEL = int(LEVELS * np.log(10) / np.log(2 * SAMPLE_DOCS))  # of shingles that a thousandth of the sample holds
MULTIPLIERS = np.random.default_rng(7).integers(1, 2**63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SIGNED = "row long, doc_id long, n_shingles long, h1 long, h2 long, minwise binary, sketch binary, prefix binary, parity binary"


def signatures(sets: Sets) -> np.ndarray:
    """Minwise tokens, one for each document and function, as unsigned 32-bit integers."""
    spread = mix(sets.values)
    return np.stack([reduced(np.minimum, ((spread * m) >> np.uint64(32)).astype(np.uint32), sets.bounds, 0) for m in MULTIPLIERS], 1)


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a bounded sample hold, ascending, and how common each is, 1 to LEVELS.

    It only sets the order of the prefix filter, which is exact in any order that all documents share.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(plain(batch["text"])):
                values, counts = np.unique(shingle_sets(texts).values, return_counts=True)
                yield pa.record_batch([pa.array(values.view(np.int64)), pa.array(counts)], ["value", "n"])

    sample = bounded_sample(docs.select("doc_id", "text"), "doc_id", SAMPLE_DOCS)
    counts = sample.mapInArrow(lean(work), "value long, n long").groupBy("value").agg(F.sum("n").alias("n")).filter("n > 1")
    found = counts.orderBy(F.desc("n"), "value").limit(COMMON_SHINGLES).toArrow()
    values, n = found["value"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(values)
    level = np.minimum(LEVELS, np.ceil(LEVELS * np.log(np.maximum(n, 1)) / np.log(2 * SAMPLE_DOCS))).astype(np.uint64)
    return values[order].view(np.uint64), level[order]


def prefixes(sets: Sets, common: np.ndarray, level: np.ndarray) -> pa.Array:
    """The first shingles of each set in the global order, as ascending keys of the level and the shingle: all
    at which a linked set can have the first shingle in common, which are n - ceil(PERCENT / 100 * n) + 1."""
    keys, sizes = sets.values, sets.sizes()
    if len(common) and len(keys):
        at = np.minimum(np.searchsorted(common, keys), len(common) - 1)
        keys = (np.where(common[at] == keys, level[at], np.uint64(0)) << np.uint64(VALUE_BITS)) | keys
        doc = np.repeat(np.arange(len(sizes)), sizes)
        keys = keys[np.argsort((doc << 10) | (keys >> np.uint64(VALUE_BITS)).astype(np.int64), kind="stable")]
    wanted = np.where(sizes > 0, sizes + (-PERCENT * sizes) // 100 + 1, 0)
    place = np.arange(len(keys)) - np.repeat(sets.bounds[:-1], sizes)
    keys = keys[place < np.repeat(wanted, sizes)]
    bounds = np.concatenate([[0], np.cumsum(wanted * 8)]).astype("<i4").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(keys.astype("<u8").tobytes())])


def widths(sizes: np.ndarray) -> np.ndarray:
    """Bits of the parity bitmaps of sets of these sizes: a power of two, four times the size or more where it can be."""
    return np.clip(1 << np.ceil(np.log2(4 * np.maximum(sizes, 1))).astype(np.int64), NARROWEST, WIDEST)


def parities(sets: Sets) -> pa.Array:
    """A bitmap of each set: a bit is the parity of the number of shingles that fall on it. Two sets differ in as
    many shingles at least as their bitmaps in bits. A half laid over the other gives the bitmap of half the bits."""
    sizes = sets.sizes()
    bits = widths(sizes)
    starts = np.concatenate([[0], np.cumsum(bits)])
    at = np.repeat(starts[:-1], sizes) + (mix(sets.values ^ np.uint64(0xB17B17)) & np.repeat(bits - 1, sizes).astype(np.uint64)).astype(np.int64)
    data = np.packbits((np.bincount(at, minlength=int(starts[-1])) & 1).astype(np.uint8), bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((starts // 8).astype("<i4").tobytes()), pa.py_buffer(data.tobytes())])


def set_hashes(sets: Sets) -> list[np.ndarray]:
    """Two hashes of 64 bits of each set."""
    return [reduced(np.add, mix(sets.values + np.uint64(s)), sets.bounds, 0).view(np.int64) for s in (0x51ED27, 0xA5A5A5A5)]


def sign(docs: DataFrame) -> DataFrame:
    """A number, the set size, a 128-bit hash of the set, the minwise tokens, a byte of each, the prefix and the
    parity bitmap, for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(plain(batch["text"])):
                sets = shingle_sets(texts)
                tokens = signatures(sets)
                sketch = (tokens >> np.uint32(3)).astype(np.uint8)
                own = (batch[c].slice(at, len(texts)) for c in ("row", "doc_id"))
                yield pa.record_batch(
                    [*own, pa.array(sets.sizes()), *map(pa.array, set_hashes(sets)), binary(tokens.astype("<u4")), binary(sketch), prefixes(sets, *sent.value), parities(sets)],
                    ["row", "doc_id", "n_shingles", "h1", "h2", "minwise", "sketch", "prefix", "parity"],
                )
                at += len(texts)

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(lean(work), SIGNED)


def binary(rows: np.ndarray) -> pa.Array:
    """A column with the bytes of each row of a matrix."""
    width = rows.shape[1] * rows.itemsize
    bounds = (np.arange(len(rows) + 1) * width).astype("<i4").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def matrix(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int32)
    if column.buffers()[2] is None:
        return np.zeros((0, width), dtype=dtype)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[bounds[column.offset] : bounds[column.offset + len(column)]]
    return data.view(dtype).reshape(len(column), width)


def child(node: np.ndarray, function: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(mix(node.view(np.uint64) ^ (function.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) ^ token.astype(np.uint64)).view(np.int64)


def roots(signed: DataFrame, trees: int) -> DataFrame:
    """node, doc_id of every document in every tree's first level."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = matrix(batch["minwise"], "<u4", FUNCTIONS)
            for t in range(trees):
                n = np.full(len(batch), t)
                yield pa.record_batch([pa.array(child(n.astype(np.int64), n, tokens[:, t])), batch["doc_id"]], ["node", "doc_id"])

    return signed.select("doc_id", "minwise").mapInArrow(lean(work), "node long, doc_id long")


def branches(large: DataFrame) -> DataFrame:
    """The children of large nodes' members: by two functions that the node picks, or one for members that may be
    linked with a leader, which stay together more often and which the leaders connect."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            tokens, node = matrix(batch["minwise"], "<u4", FUNCTIONS), batch["node"].to_numpy()
            close = np.asarray(batch["agree"]) >= SUPPORT
            picked = mix(node.view(np.uint64) + np.uint64(0xC0FFEE))
            for b in range(2):
                function = ((picked >> np.uint64(16 * b)) % np.uint64(FUNCTIONS)).astype(np.int64)
                rows = np.flatnonzero(~close) if b else np.arange(len(batch))
                kids = child(node[rows], function[rows], tokens[rows, function[rows]])
                yield pa.record_batch([pa.array(kids), batch["doc_id"].take(pa.array(rows))], ["node", "doc_id"])

    return large.select("node", "doc_id", "minwise", "agree").mapInArrow(lean(work), "node long, doc_id long")


def alike(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Can sets of these sizes reach the limit at all?"""
    return 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)


def nearest(x: np.ndarray, y: np.ndarray, agree: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of pairs of positions, those that give a member its most similar partner, and its first partner, by a hash
    that is the same in all nodes, among those that agree in SURE functions."""
    row, other, score = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([agree, agree])
    order = mix(ids[other].view(np.uint64))
    chosen = []
    for keys, rows in (((order, -score, row), np.arange(len(row))), ((order, row), np.flatnonzero(score >= SURE))):
        ranked = rows[np.lexsort([k[rows] for k in keys])]
        first = np.append(True, row[ranked][1:] != row[ranked][:-1]) if len(ranked) else np.zeros(0, dtype=bool)
        chosen.append(ranked[first] % len(x))
    return np.unique(np.concatenate(chosen)) if len(x) else np.zeros(0, dtype=np.int64)


def compare_small(rows: DataFrame) -> DataFrame:
    """a, b, agree: all members of each node are compared by size and sketch.

    ``rows(node, doc_id, n_shingles, sketch)`` of nodes of at most SMALL_NODE members: each member gives at most
    two pairs (``nearest``). Rows stream sorted by node; the node that a batch ends in is carried into the next.
    """

    def pairs(batch: pa.RecordBatch) -> pa.RecordBatch:
        node, ids, sizes = (batch[c].to_numpy() for c in ("node", "doc_id", "n_shingles"))
        sketch = matrix(batch["sketch"], "u1", FUNCTIONS)
        out, apart = [], 1
        while apart < len(node):
            at = np.flatnonzero(node[apart:] == node[:-apart])
            if not len(at):
                break
            at = at[alike(sizes[at], sizes[at + apart])]
            for i in range(0, len(at), 100_000):
                x = at[i : i + 100_000]
                agree = (sketch[x] == sketch[x + apart]).sum(1)
                x, agree = x[agree >= SUPPORT], agree[agree >= SUPPORT]
                out.append((x, x + apart, agree))
            apart += 1
        x, y, agree = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, dtype=np.int64),) * 3
        kept = nearest(x, y, agree, ids)
        x, y, agree = x[kept], y[kept], agree[kept]
        a, b = ids[x], ids[y]
        return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(agree.astype(np.int32))], ["a", "b", "agree"])

    return by_groups(rows, "node", pairs, "a long, b long, agree int")


def by_groups(rows: DataFrame, key: str, answer: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``answer`` of batches of ``rows`` sorted by ``key`` that hold whole groups of equal keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            keys = batch[key].to_numpy()
            if kept and keys[-1] == kept[0][key][0].as_py():
                kept.append(batch)
                continue
            batch = pa.Table.from_batches([*kept, batch]).combine_chunks().to_batches()[0]
            keys = batch[key].to_numpy()
            last = int(np.searchsorted(keys, keys[-1]))
            yield answer(batch.slice(0, last))
            kept = [batch.slice(last)]
        if kept:
            yield answer(pa.Table.from_batches(kept).combine_chunks().to_batches()[0])

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(lean(work), schema)


def early(sizes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Can a shingle at this place be the first that the smaller set of a link has in common with the larger?"""
    return 2 * PERCENT * sizes <= (100 + PERCENT) * (sizes - place)


def can_link(rows: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of positions (x, y) in one group, those of different components that can still be linked: with the group's
    shingle as the first in common, what follows it in the smaller rest must reach the overlap of a link."""
    n, m = rows["n_shingles"][x], rows["n_shingles"][y]
    rest = np.minimum(n - rows["place"][x], m - rows["place"][y])
    return ((100 + PERCENT) * rest >= PERCENT * (n + m)) & (rows["component"][x] != rows["component"][y]) & alike(n, m)


def in_some_pair(rows: dict[str, np.ndarray]) -> np.ndarray:
    """Which members of small groups, sorted by key, can be linked with another one of their group."""
    hit = np.zeros(len(rows["key"]), dtype=bool)
    for step in range(1, SMALL_GROUP):
        at = np.flatnonzero(rows["key"][step:] == rows["key"][:-step]) if len(hit) > step else np.zeros(0, dtype=np.int64)
        if not len(at):
            break
        at = at[can_link(rows, at, at + step)]
        hit[at] = hit[at + step] = True
    return hit


def in_crowd(rows: dict[str, np.ndarray], members: np.ndarray, bitmaps: list[bytes], nearest_alone: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (x, y) of one crowd's members that can be linked and whose bitmaps allow the overlap of a link:
    all of them, or for each x the one whose bitmaps agree best.

    Members of one bitmap width are compared with each other and with those of twice that width, folded; others
    are no match by size. Members of different blocks are compared only where the crowd joins two blocks.
    """
    sizes, block = rows["n_shingles"], rows["block"]
    first = early(sizes, rows["place"])
    bits = widths(sizes[members])
    two = block[members].min() < block[members].max()
    for width in np.unique(bits):
        same, wide = members[bits == width], members[bits == 2 * width]
        own = np.frombuffer(b"".join([bitmaps[i] for i in same]), dtype=np.uint64).reshape(len(same), -1)
        other = np.frombuffer(b"".join([bitmaps[i] for i in wide]), dtype=np.uint64).reshape(len(wide), 2, own.shape[1])
        facing, maps = np.concatenate([same, wide]), np.concatenate([own, other[:, 0] ^ other[:, 1]])
        lead = np.flatnonzero(first[same])
        for i in range(0, len(lead), step := max(1, CELLS // len(facing))):
            part = lead[i : i + step]
            p, q = np.repeat(part, len(facing)), np.tile(np.arange(len(facing)), len(part))
            # Of two early members each is met from the other as well; the smaller set of a link has no wider bitmap.
            fresh = (q >= len(same)) | ~first[facing[q]] | (p < q)
            if two:
                fresh &= block[same[p]] != block[facing[q]]
            p, q = p[fresh], q[fresh]
            ok = can_link(rows, same[p], facing[q])
            p, q = p[ok], q[ok]
            total = sizes[same[p]] + sizes[facing[q]]
            apart = np.concatenate([np.zeros(0, dtype=np.int64), *(np.bitwise_count(own[p[j : j + PAIRS]] ^ maps[q[j : j + PAIRS]]).sum(1, dtype=np.int64) for j in range(0, len(p), PAIRS))])
            hit = np.flatnonzero((100 + PERCENT) * (total - apart) >= 2 * PERCENT * total)
            if nearest_alone:
                hit = hit[np.lexsort((apart[hit] / total[hit], p[hit]))]
                hit = hit[np.append(True, p[hit][1:] != p[hit][:-1])[: len(hit)]]
            yield same[p[hit]], facing[q[hit]]


MEMBER = "doc_id long, n_shingles long, component long, place int"


def spread(labelled: DataFrame, hot: bool) -> DataFrame:
    """key and what ``can_link`` needs for each shingle of each prefix, of those that the sample shows as hot or of the others."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                rows = [np.frombuffer(p, dtype="<i8") for p in part["prefix"].to_pylist()]
                lengths = np.array([len(r) for r in rows])
                keys, owner = np.concatenate(rows), np.repeat(np.arange(len(part)), lengths)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                wanted = np.flatnonzero(((keys.view("<u8") >> np.uint64(VALUE_BITS)) >= HOT_LEVEL) == hot)
                columns = (part[c].to_numpy()[owner[wanted]] for c in ("doc_id", "n_shingles", "component"))
                yield pa.record_batch([pa.array(keys[wanted]), *map(pa.array, columns), pa.array(place[wanted].astype(np.int32))], ["key", "doc_id", "n_shingles", "component", "place"])

    return labelled.select("doc_id", "n_shingles", "component", "prefix").mapInArrow(lean(work), f"key long, {MEMBER}")


def unique_pairs(ids: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids (smaller, larger) of pairs of positions, once each."""
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 2
    x, y = (ids[np.concatenate(c)] for c in zip(*found, strict=True))
    both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
    return both[:, 0], both[:, 1]


def columns_of(batch: pa.RecordBatch, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    return {c: batch[c].to_numpy() for c in names}


def met(rows: DataFrame) -> DataFrame:
    """Those of ``rows`` that can be linked with another row of their key, and all of the larger groups.

    Rows stream sorted by key; at most SMALL_GROUP members of a group are held back.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, crowd = None, None

        def answer(batch: pa.RecordBatch) -> pa.RecordBatch:
            held = columns_of(batch, ("key", "n_shingles", "component", "place"))
            counts = np.diff(np.append(np.flatnonzero(np.append(True, held["key"][1:] != held["key"][:-1])), len(batch)))
            large = np.repeat(counts > SMALL_GROUP, counts) | (held["key"] == crowd if crowd is not None else False)
            some = np.flatnonzero(~large)
            large[some] = in_some_pair({c: v[some] for c, v in held.items()})
            return batch.filter(pa.array(large))

        for batch in batches:
            if not len(batch):
                continue
            batch = pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0] if kept is not None else batch
            keys = batch["key"].to_numpy()
            last = int(np.searchsorted(keys, keys[-1]))
            if len(keys) - last > SMALL_GROUP or keys[-1] == crowd:
                last = len(keys)  # a crowd needs no other member to be known as one
            yield answer(batch.slice(0, last))
            if last == len(keys):
                kept, crowd = None, keys[-1]
            else:
                kept, crowd = batch.slice(last), None
        if kept is not None:
            yield answer(kept)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(lean(work), f"key long, {MEMBER}")


def crowd_pairs(members: DataFrame, parity: DataFrame, nearest_alone: bool) -> DataFrame:
    """a, b: pairs of ``members(key, doc_id, n_shingles, component, place)`` that share a key and can be linked; all,
    or the nearest of each member in each group.

    Keys without two components or an early member give none. A key's members are dealt into blocks of about
    CROWD_BLOCK, and every two blocks, and each with itself, meet in one group.
    """
    first = F.expr(f"{2 * PERCENT} * n_shingles <= {100 + PERCENT} * (n_shingles - place)")
    crowds = members.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("least"), F.max("component").alias("most"), F.max(first).alias("early"))
    crowds = crowds.filter("early AND least < most").select("key", F.ceil(F.col("n") / CROWD_BLOCK).cast("int").alias("blocks"))
    dealt = members.join(crowds, "key").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    one = dealt.filter("blocks = 1").select(F.col("key").alias("meet"), "doc_id", "n_shingles", "component", "place", "block")
    more = dealt.filter("blocks > 1").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    more = more.select(F.xxhash64("key", F.least("block", "with"), F.greatest("block", "with")).alias("meet"), "doc_id", "n_shingles", "component", "place", "block")

    def pairs(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = columns_of(batch, ("meet", "doc_id", "n_shingles", "component", "place", "block"))
        bitmaps = batch["parity"].to_pylist()
        starts = np.flatnonzero(np.append(True, rows["meet"][1:] != rows["meet"][:-1])) if len(batch) else []
        found = [pair for x, y in zip(starts, np.append(starts, len(batch))[1:].astype(int), strict=True) for pair in in_crowd(rows, np.arange(x, y), bitmaps, nearest_alone)]
        return pa.record_batch([*map(pa.array, unique_pairs(rows["doc_id"], found))], ["a", "b"])

    return by_groups(one.union(more).join(parity, "doc_id"), "meet", pairs, "a long, b long")


def with_component(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows(doc_id, ...)`` with their component by ``groups(node, component)``; alone, it is their own."""
    return rows.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def prefix_members(reps: DataFrame, groups: DataFrame) -> DataFrame:
    """key, doc_id, n_shingles, component, place of the prefixes' shingles at which two sets of different components
    meet that can be linked."""
    labelled = with_component(reps.select("doc_id", "n_shingles", "prefix"), groups)
    return materialize(met(spread(labelled, False)).union(spread(labelled, True)), "members")


@F.pandas_udf(T.IntegerType())
def agreement(mine: pd.Series, other: pd.Series) -> pd.Series:
    """How many minwise tokens two sketches have in common."""
    x, y = (np.frombuffer(b"".join(c), dtype=np.uint8).reshape(-1, FUNCTIONS) for c in (mine, other))
    return pd.Series((x == y).sum(1), dtype="int32")


def grow(signed: DataFrame, trees: int = TREES, depth: int = DEPTH, small: int = SMALL_NODE) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The trees: node, doc_id of all small nodes, a, b, agree of large nodes' members with the best of their leaders,
    and the tables that the first reads.

    Documents that share a rare token meet in a small node of the first level, so there are many trees of it; large
    nodes branch on. What meets in no small node is left to ``remaining``.
    """
    leaves, stars, used, crowds, rows = [], [], [], [], roots(signed, trees)
    facts = signed.select("doc_id", "n_shingles", "sketch")
    order, other = (F.struct(F.xxhash64("doc_id", F.lit(seed)).alias("o"), "doc_id") for seed in (1, 2))
    for level in range(depth + 1):
        nodes = rows.groupBy("node").agg(F.count("*").alias("members"), F.min(order).alias("x"), F.max(order).alias("y"), F.min(other).alias("z")).filter("members > 1")
        active = materialize(rows.join(nodes.select("node", "members", *[F.col(f"{k}.doc_id").alias(k) for k in LEADERS]), "node"), "nodes")
        used.append(active)
        many = active.filter(F.col("members") > small)
        leaves.append(active.filter(F.col("members") <= small).select("node", "doc_id"))
        leaders = many.select("node", *LEADERS).distinct()
        for k in LEADERS:
            leaders = leaders.join(facts.select(F.col("doc_id").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}")), k)
        large = many.drop(*LEADERS).join(signed.select("doc_id", "n_shingles", "sketch", "minwise"), "doc_id").join(leaders, "node")
        large = large.select("node", "doc_id", "n_shingles", "minwise", *LEADERS, *[f"n_{k}" for k in LEADERS], *[agreement("sketch", f"sketch_{k}").alias(f"agree_{k}") for k in LEADERS])
        large = materialize(large.withColumn("agree", F.greatest(*[f"agree_{k}" for k in LEADERS])), "large")
        crowds.append(large)
        can = lambda k: (F.col(f"agree_{k}") >= SUPPORT) & (F.col("doc_id") != F.col(k)) & (100 * F.least("n_shingles", f"n_{k}") >= PERCENT * F.greatest("n_shingles", f"n_{k}"))
        best = F.greatest(*[F.when(can(k), F.struct(F.col(f"agree_{k}").alias("agree"), F.col(k).alias("leader"))) for k in LEADERS])
        met = large.select("doc_id", best.alias("best")).filter("best IS NOT NULL")
        stars.append(met.select(F.least("doc_id", "best.leader").alias("a"), F.greatest("doc_id", "best.leader").alias("b"), F.col("best.agree").alias("agree")))
        if level == depth or large.isEmpty():
            break
        rows = branches(large)
    stars = materialize(reduce(DataFrame.union, stars).distinct(), "stars")
    discard(*crowds)
    return reduce(DataFrame.union, leaves), stars, used


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` whose full shingle sets reach the limit."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                sides = [[s.values[x:y] for t in slices(plain(part[c])) for s in [shingle_sets(t)] for x, y in zip(s.bounds, s.bounds[1:], strict=False)] for c in ("text_a", "text_b")]
                keep = []
                for x, y in zip(*sides, strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True)) if len(x) and len(y) else 0
                    keep.append(bool(common) and 100 * common >= PERCENT * (len(x) + len(y) - common))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(lean(work), "a long, b long")


def texts_for(docs: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id (the set's number) and text of the sets in some pairs: rows of the document that the number stands for,
    and of these the ones with that set. The ids are broadcast if they are few, by count."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    ids = materialize(ids.join(reps.select("doc_id", "source_id", "h1", "h2"), "doc_id"), "ids")
    wanted = ids.select(F.col("source_id").alias("doc_id"), F.col("doc_id").alias("node"), "h1", "h2")
    wanted = F.broadcast(wanted) if ids.count() <= BROADCAST_IDS else wanted

    def same_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(plain(batch["text"])):
                part = batch.slice(at, len(texts))
                own = set_hashes(shingle_sets(texts))
                same = (own[0] == part["h1"].to_numpy()) & (own[1] == part["h2"].to_numpy())
                yield pa.record_batch([part["node"], texts], ["doc_id", "text"]).filter(pa.array(same))
                at += len(texts)

    return materialize(docs.select("doc_id", "text").join(wanted, "doc_id").mapInArrow(lean(same_set), "doc_id long, text string"), "texts")


def confirm(docs: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    texts = texts_for(docs, reps, pairs)
    linked = materialize(confirmed(pairs, texts), "linked")
    discard(texts)
    return linked


def links_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Confirmed links that connect all that is linked: at most two candidates of the trees for each document, then
    the nearest pairs that a prefix's shingles bring together, then all pairs that can be linked and still lie
    between different components."""
    leaves, stars, used = grow(reps)
    facts = reps.select("doc_id", "n_shingles", "sketch")
    near = compare_small(leaves.join(facts, "doc_id")).union(stars)
    both = near.union(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "agree"))
    order = (-F.xxhash64("b")).alias("o")
    best = both.groupBy("a").agg(F.max(F.struct("agree", order, "b")).alias("x"), F.max(F.struct((F.col("agree") >= SURE).alias("sure"), order, "b")).alias("y"))
    two = best.select("a", F.explode(F.array("x.b", "y.b")).alias("b"))
    first = materialize(two.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "first")
    discard(*used)
    linked, tried = confirm(docs, reps, first), first
    members = prefix_members(reps, components(linked))
    # What is alike in a crowd is joined by its nearest pairs, so that few pairs are left between components.
    for nearest_alone in (True, False):
        rows = with_component(members.drop("component"), components(linked)) if not nearest_alone else members
        pairs = crowd_pairs(rows, reps.select("doc_id", "parity"), nearest_alone).distinct().join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        linked, tried = linked.union(confirm(docs, reps, pairs)), tried.union(pairs)
    return linked


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs(doc_id, text, ...)``.

    Whole texts. A null text or one without words has an empty set and is linked with nothing; fewer than
    five words make one shingle; equal sets are linked whatever their texts. Rows without a doc_id keep no
    component and are kept. Each row is judged by its own text: repeated rows share their component, and of rows
    that share a doc_id but no text each has the component of its own; further columns are ignored; an empty
    table gives an empty result. Equal sets are grouped first, by a partial aggregate, so groups of copies of any
    size cost one row each afterwards.
    """
    signed = materialize(sign(docs), "signed")
    rows = materialize(signed.select("row", "doc_id", "n_shingles", "h1", "h2"), "rows")
    own = ["h1", "h2", "n_shingles"]
    sets = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*own).agg(F.min(F.struct("doc_id", "row")).alias("first"))
    sets = materialize(sets.select(*own, F.col("first.doc_id").alias("rep"), F.col("first.row").alias("node")), "sets")
    reps = signed.join(sets.select(F.col("node").alias("row")), "row", "left_semi")
    reps = materialize(reps.withColumnRenamed("doc_id", "source_id").withColumnRenamed("row", "doc_id"), "reps")
    discard(signed)
    found = sets.join(components(links_of(docs, reps)), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = found.groupBy("component").agg(F.min("rep").alias("component_id"))
    labels = found.join(least, "component").select(*own, "component_id")
    out = rows.join(labels, own, "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
