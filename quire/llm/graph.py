"""Embedding near duplicates through a robust-pruned flat graph over overlapping cluster shards."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.components import components
from quire.llm.tables import SAMPLE_SPACE, table
from quire.llm.vectors import block, usable
from quire.shared import materialize

LIMIT = 0.9
CLUSTER_ROWS, SHARD_ROWS, CHUNK_QUERIES = 1024, 1536, 4096
MAX_CLUSTERS, SAMPLE_ROWS = 4096, 40_000
OVERLAP, PROBES = 2, 3
DEGREE, NEAREST, FAR, ALPHA = 24, 48, 16, 1.2
STARTS, BEAM, SLACK = 48, 32, 0.1
AUDITED, RECALL = 1024, 0.97
FEW, BLOCK_ROWS = 8, 2048


# --- one shard, in numpy -----------------------------------------------------------------------


def neighbours(points: np.ndarray, degree: int = DEGREE, seed: int = 3) -> np.ndarray:
    """Robust-pruned out-neighbours [n, degree] (-1: none): of each point's nearest and some random ones,
    the closest is kept again and again, and those closer to it than to the point, by ALPHA, are dropped."""
    n = len(points)
    if n < 2:
        return np.full((n, degree), -1, dtype=np.int64)
    apart = np.maximum(2 - 2 * (points @ points.T), 0)
    near = apart.copy()
    np.fill_diagonal(near, np.inf)
    k = min(NEAREST, n - 1)
    pool = np.argpartition(near, k - 1, axis=1)[:, :k]
    far = np.random.default_rng(seed).integers(0, n, (n, FAR))
    pool = np.concatenate([pool, far], 1)
    pool = np.take_along_axis(pool, np.argsort(np.take_along_axis(near, pool, 1), axis=1, kind="stable"), 1)
    gaps = np.take_along_axis(near, pool, 1)
    alive = np.isfinite(gaps)
    out, rows = np.full((n, degree), -1, dtype=np.int64), np.arange(n)
    for r in range(degree):
        any_left = alive.any(1)
        if not any_left.any():
            break
        pick = pool[rows, alive.argmax(1)]
        out[any_left, r] = pick[any_left]
        alive &= ALPHA * apart[pick[:, None], pool] > gaps
        alive &= pool != pick[:, None]
    return out


def both_ways(edges: np.ndarray, points: np.ndarray, sure: int = 6) -> np.ndarray:
    """(from, to) pairs of a graph with edges back as well, each point's closest 2 * DEGREE; those back from a
    point's ``sure`` nearest neighbours stay in any case, so that points that nobody lists can be reached."""
    n = max(1, len(edges))
    rows, place = np.nonzero(edges >= 0)
    to = edges[edges >= 0]
    back = to * n + rows
    a, b = np.concatenate([rows, to]), np.concatenate([to, rows])
    order = np.lexsort((-np.einsum("ij,ij->i", points[a], points[b]), a))
    a, b = a[order], b[order]
    near = np.arange(len(a)) - np.searchsorted(a, a) < 2 * DEGREE
    code = np.unique(np.concatenate([(a * n + b)[near], back[place < sure]]))
    return np.stack([code // n, code % n], 1)


def medoids(points: np.ndarray, count: int = STARTS) -> np.ndarray:
    """The point nearest the mean, then the farthest from those taken: where searches begin."""
    if not len(points):
        return np.zeros(0, dtype=np.int64)
    taken = [int((points @ points.mean(0)).argmax())]
    close = points @ points[taken[0]]
    while len(taken) < min(count, len(points)):
        taken.append(int(close.argmin()))
        close = np.maximum(close, points @ points[taken[-1]])
    return np.unique(taken)


def range_search(queries: np.ndarray, points: np.ndarray, edges: np.ndarray, starts: np.ndarray, limit: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) pairs with cosine >= limit: greedy beam search from the medoids until a query meets a
    point in range or its beam is spent; then the range is expanded along the graph from what was met."""
    found_q, found_p = [], []
    for at in range(0, len(queries), 512):
        some = queries[at : at + 512]
        n, m = len(some), len(points)
        seen = np.zeros((n, m), dtype=bool)
        seen[:, starts] = True
        sims = some @ points[starts].T
        ids = np.broadcast_to(starts, sims.shape)
        if len(starts) > beam:
            top = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
            ids, sims = (np.take_along_axis(x, top, 1) for x in (ids, sims))
        ids, done = ids.copy(), np.zeros(ids.shape, dtype=bool)
        active = np.arange(n)
        for _ in range(4 * beam):
            open_sims = np.where(done[active], -np.inf, sims[active])
            pick = open_sims.argmax(1)
            go = np.isfinite(open_sims[np.arange(len(active)), pick]) & (sims[active].max(1) < limit)
            active, pick = active[go], pick[go]
            if not len(active):
                break
            done[active, pick] = True
            nodes = edges[ids[active, pick]]
            fresh = (nodes >= 0) & ~seen[active[:, None], nodes]
            safe = np.where(fresh, nodes, 0)
            owner = np.repeat(active, fresh.sum(1))
            seen[owner, nodes[fresh]] = True
            more = np.full(fresh.shape, -np.inf)
            more[fresh] = np.einsum("ij,ij->i", some[owner], points[nodes[fresh]])
            all_ids, all_sims = np.concatenate([ids[active], safe], 1), np.concatenate([sims[active], more], 1)
            all_done = np.concatenate([done[active], ~fresh], 1)
            if all_ids.shape[1] > beam:
                top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
                all_ids, all_sims, all_done = (np.take_along_axis(x, top, 1) for x in (all_ids, all_sims, all_done))
            if ids.shape[1] != all_ids.shape[1]:
                grow = all_ids.shape[1] - ids.shape[1]
                ids, sims, done = np.pad(ids, ((0, 0), (0, grow))), np.pad(sims, ((0, 0), (0, grow)), constant_values=-np.inf), np.pad(done, ((0, 0), (0, grow)), constant_values=True)
            ids[active], sims[active], done[active] = all_ids, all_sims, all_done
        q, c = np.nonzero(sims >= limit - SLACK)
        p = ids[q, c]
        seen[:] = False
        code = np.unique(q * m + p)
        while len(code):
            q, p = code // m, code % m
            seen[q, p] = True
            exact = np.concatenate([np.einsum("ij,ij->i", some[q[i : i + 100_000]], points[p[i : i + 100_000]]) for i in range(0, len(q), 100_000)])
            hit = exact >= limit
            found_q.append(q[hit] + at)
            found_p.append(p[hit])
            q, p = q[exact >= limit - SLACK], p[exact >= limit - SLACK]
            parts = []
            for i in range(0, len(q), 50_000):
                nodes = edges[p[i : i + 50_000]]
                owner = np.broadcast_to(q[i : i + 50_000, None], nodes.shape)
                ok = nodes >= 0
                ok[ok] &= ~seen[owner[ok], nodes[ok]]
                parts.append(np.unique(owner[ok] * m + nodes[ok]))
            code = np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.int64)
    return (np.concatenate(found_q), np.concatenate(found_p)) if found_q else (np.zeros(0, dtype=np.int64),) * 2


def local_roots(a: np.ndarray, b: np.ndarray) -> dict[int, int]:
    """Smallest node reachable from each node of some links."""
    names, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = codes[: len(a)], codes[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return dict(zip(names.tolist(), names[root].tolist(), strict=True))
        root = new


# --- the shards, in Spark ----------------------------------------------------------------------


@dataclass(frozen=True)
class Clusters:
    centers: np.ndarray
    shards: tuple[int, ...] = ()
    parts: tuple[int, ...] = ()

    def nearest(self, rows: np.ndarray, count: int) -> np.ndarray:
        close = rows @ self.centers.T
        return np.argsort(-close, axis=1, kind="stable")[:, :count]


def fit_clusters(reps: DataFrame, total: int) -> Clusters:
    """Spherical k-means on about SAMPLE_ROWS vectors, by a hash of their ids; at most MAX_CLUSTERS centers."""
    share = SAMPLE_SPACE if total <= SAMPLE_ROWS else max(1, SAMPLE_ROWS * SAMPLE_SPACE // total)
    found = reps.filter(F.pmod(F.xxhash64(F.lit(31), "vec_id"), F.lit(SAMPLE_SPACE)) < share).orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * SAMPLE_ROWS).collect()
    rows = np.stack([np.frombuffer(bytes(r["v"]), dtype="<f8") for r in found])
    centers = rows[: max(1, min(MAX_CLUSTERS, len(rows), total // CLUSTER_ROWS))]
    for _ in range(10):
        owner = (rows @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, owner, rows)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(size > 0, sums / np.where(size > 0, size, 1), centers)
    return Clusters(centers)


def unit_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, length and the unit vector in doubles, of vectors of any length; zero vectors are left out."""
    valid = vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(v) for v in batch["v"].to_pylist()], dtype=np.int64)
            for length in np.unique(lengths[lengths > 0]):
                part = batch.take(pa.array(np.flatnonzero(lengths == length)))
                rows = np.array(part["v"].to_pylist(), dtype="<f8")
                rows = rows / np.where(abs(rows).max(1, keepdims=True) > 0, abs(rows).max(1, keepdims=True), 1)
                size = np.linalg.norm(rows, axis=1)
                keep = np.flatnonzero(size > 0)
                yield pa.record_batch([part["vec_id"].take(pa.array(keep)), pa.array(np.full(len(keep), length, dtype=np.int32)), pa.array([r.tobytes() for r in rows[keep] / size[keep, None]], pa.binary())], ["vec_id", "length", "v"])

    return valid.mapInArrow(work, "vec_id long, length int, v binary")


def build_shards(reps: DataFrame, clusters: Clusters) -> DataFrame:
    """One row for each shard: ids, homes (each vector's clusters), weights, vectors and edges.

    Each vector lies in the shards of its OVERLAP nearest clusters. The adjacency lists that the shards give
    it are united, and each shard keeps the united edges between its own vectors.
    """
    sent = reps.sparkSession.sparkContext.broadcast(clusters)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            near = sent.value.nearest(block(batch["v"]), OVERLAP)
            for c in range(near.shape[1]):
                subs = [(i * 0x9E3779B1 >> 7) % sent.value.shards[k] for i, k in zip(batch["vec_id"].to_pylist(), near[:, c].tolist(), strict=True)]
                homes = pa.array(near.tolist(), pa.list_(pa.int32()))
                yield pa.record_batch([pa.array(near[:, c], pa.int32()), pa.array(subs, pa.int32()), batch["vec_id"], batch["weight"], batch["v"], homes], ["cluster", "shard", "vec_id", "weight", "v", "homes"])

    placed = materialize(reps.mapInArrow(place, "cluster int, shard int, vec_id long, weight long, v binary, homes array<int>"), "placed")

    def link(table: pa.Table) -> pa.Table:
        ids, points = table["vec_id"].to_numpy(), block(table["v"].combine_chunks())
        edges = neighbours(points)
        pairs = both_ways(edges, points)
        return pa.table([pa.array(ids[pairs[:, 0]]), pa.array(ids[pairs[:, 1]])], ["vec_id", "to"])

    united = placed.groupBy("cluster", "shard").applyInArrow(link, "vec_id long, to long").groupBy("vec_id").agg(F.collect_set("to").alias("to"))

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        table, ids = table.take(pa.array(order)), ids[order]
        lists = []
        for to in table["to"].to_pylist():
            to = np.array(to or [], dtype=np.int64)
            at = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
            lists.append(at[ids[at] == to])
        edges = np.full((len(ids), max([1, *map(len, lists)])), -1, dtype="<i4")
        for i, to in enumerate(lists):
            edges[i, : len(to)] = to
        homes = np.full((len(ids), OVERLAP), -1, dtype="<i4")
        for i, h in enumerate(table["homes"].to_pylist()):
            homes[i, : len(h)] = h
        points = block(table["v"].combine_chunks())
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids.astype("<i8"), table["weight"].to_numpy().astype("<i8"), homes, points, edges))], ["cluster", "shard", "ids", "weights", "homes", "points", "edges"])

    return materialize(placed.join(united, "vec_id", "left").groupBy("cluster", "shard").applyInArrow(pack, "cluster int, shard int, ids binary, weights binary, homes binary, points binary, edges binary"), "shards")


def search_shards(reps: DataFrame, shards: DataFrame, clusters: Clusters, probes: int, beam: int, limit: float) -> DataFrame:
    """vec_id, n (weight of the vectors that it found linked), back (of those that found it), root (smallest vector
    of its links in one shard).

    Every vector asks all shards of its ``probes`` nearest clusters. A found vector counts where the first of
    its homes that the query asks is the shard's cluster, so no pair counts twice and none need be listed.
    """
    spark = reps.sparkSession
    sent = spark.sparkContext.broadcast(clusters)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            near = sent.value.nearest(block(batch["v"]), probes)
            asked = pa.array(near.tolist(), pa.list_(pa.int32()))
            for c in range(near.shape[1]):
                k = near[:, c]
                shards_of, parts_of = np.array(sent.value.shards)[k], np.array(sent.value.parts)[k]
                part = (batch["vec_id"].to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % parts_of.astype(np.uint64)
                for s in range(int(shards_of.max())):
                    rows = pa.array(np.flatnonzero(shards_of > s))
                    n = len(rows)
                    yield pa.record_batch([pa.array(k, pa.int32()).take(rows), pa.array([s] * n, pa.int32()), pa.array(part.astype(np.int32)).take(rows), batch["vec_id"].take(rows), batch["weight"].take(rows), batch["v"].take(rows), asked.take(rows)], ["cluster", "shard", "part", "vec_id", "weight", "v", "asked"])

    routed = reps.select("vec_id", "weight", "v").mapInArrow(route, "cluster int, shard int, part int, vec_id long, weight long, v binary, asked array<int>")
    parts = spark.createDataFrame(list(enumerate(clusters.parts)), "cluster int, parts int")
    held = shards.join(F.broadcast(parts), "cluster").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def search(key: tuple[pa.Scalar, ...], asked: pa.Table, shard: pa.Table) -> pa.Table:
        names = ["vec_id", "n", "back", "root"]
        if not len(asked) or not len(shard):
            return pa.table([pa.array([], pa.int64())] * 4, names)
        ids = np.frombuffer(shard["ids"][0].as_py(), dtype="<i8")
        weights, homes = np.frombuffer(shard["weights"][0].as_py(), dtype="<i8"), np.frombuffer(shard["homes"][0].as_py(), dtype="<i4").reshape(-1, OVERLAP)
        points, edges = (np.frombuffer(shard[c][0].as_py(), dtype=t).reshape(len(ids), -1) for c, t in (("points", "<f8"), ("edges", "<i4")))
        own, rows = asked["vec_id"].to_numpy(), block(asked["v"].combine_chunks())
        q, p = range_search(rows, points, edges, medoids(points), limit, beam)
        q, p = q[own[q] != ids[p]], p[own[q] != ids[p]]
        wide = max(map(len, asked["asked"].to_pylist()))
        order = np.array([x + [-2] * (wide - len(x)) for x in asked["asked"].to_pylist()])
        second = (homes[p][:, :1] == order[q]).any(1)  # the query asks the first home as well
        here = key[0].as_py()
        counted = (homes[p][:, 0] == here) | ((homes[p][:, 1] == here) & ~second)
        q_met, p_met = q[counted], p[counted]
        met, at = np.unique(np.concatenate([own[q], ids[p]]), return_inverse=True)
        q_at, p_at = at[: len(q)][counted], at[len(q) :][counted]
        n = np.bincount(q_at, weights[p_met], len(met)).astype(np.int64)
        back = np.bincount(p_at, asked["weight"].to_numpy()[q_met], len(met)).astype(np.int64)
        roots = local_roots(own[q], ids[p]) if len(q) else {}
        return pa.table([pa.array(met), pa.array(n), pa.array(back), pa.array([roots[i] for i in met.tolist()], pa.int64())], names)

    keys = ["cluster", "shard", "part"]
    return materialize(routed.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(search, "vec_id long, n long, back long, root long"), "found")


def search_all(reps: DataFrame, total: int, limit: float) -> DataFrame:
    """As ``search_shards``, but exact: every block of vectors against every other, each pair of blocks a task's group."""
    blocks = -(-total // BLOCK_ROWS)

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        columns = table["vec_id"].to_numpy().astype("<i8"), table["weight"].to_numpy().astype("<i8"), block(table["v"].combine_chunks())
        return pa.table([pa.array([key[0].as_py()], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in columns)], ["block", "ids", "weights", "points"])

    placed = reps.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks).cast("long")))
    packed = materialize(placed.groupBy("block").applyInArrow(pack, "block long, ids binary, weights binary, points binary"), "blocks")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    asking, asked = packed.withColumn("other", every), packed.withColumnRenamed("block", "other").withColumn("block", every)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["vec_id", "n", "back", "root"]
        if not len(left) or not len(right):
            return pa.table([pa.array([], pa.int64())] * 4, names)
        (own, _, rows), (ids, weights, points) = ([np.frombuffer(t[c][0].as_py(), dtype=d) for c, d in (("ids", "<i8"), ("weights", "<i8"), ("points", "<f8"))] for t in (left, right))
        hit = (rows.reshape(len(own), -1) @ points.reshape(len(ids), -1).T >= limit) & (own[:, None] != ids[None])
        q, p = np.nonzero(hit)
        roots, n = local_roots(own[q], ids[p]) if len(q) else {}, hit @ weights
        met = np.flatnonzero(n)
        return pa.table([pa.array(own[met]), pa.array(n[met]), pa.array(n[met]), pa.array([roots[i] for i in own[met].tolist()], pa.int64())], names)

    keys = ["block", "other"]
    return materialize(asking.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(compare, "vec_id long, n long, back long, root long"), "found")


def link_counts(found: DataFrame) -> DataFrame:
    """vec_id, n: the links that a vector found, or by which it was found, whichever are more: both are links, and a
    link that one side alone has met is not lost to the other."""
    return found.groupBy("vec_id").agg(F.greatest(F.sum("n"), F.sum("back")).alias("n"))


def audit(reps: DataFrame, counts: DataFrame, total: int, limit: float) -> float:
    """Mean share of its links that the search has found for a vector, of about AUDITED vectors whose links are
    counted by brute force: the least of those means over vectors with at most FEW links and with more."""
    share = SAMPLE_SPACE if total <= AUDITED else max(1, AUDITED * SAMPLE_SPACE // total)
    picked = reps.filter(F.pmod(F.xxhash64(F.lit(37), "vec_id"), F.lit(SAMPLE_SPACE)) < share).orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * AUDITED).collect()
    ids, rows = np.array([r["vec_id"] for r in picked]), np.stack([np.frombuffer(bytes(r["v"]), dtype="<f8") for r in picked])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                hit = (rows @ block(batch["v"]).T >= limit) & (ids[:, None] != batch["vec_id"].to_numpy()[None])
                yield pa.record_batch([pa.array(ids), pa.array(hit @ batch["weight"].to_numpy())], ["vec_id", "n"])

    true = reps.mapInArrow(work, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("true"))
    share_found = F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / F.col("true"))
    got = true.filter(F.col("true") > 0).join(link_counts(counts), "vec_id", "left")
    means = got.groupBy(F.col("true") <= FEW).agg(F.avg(share_found).alias("recall")).collect()
    return min((r["recall"] for r in means), default=1.0)


def found_links(reps: DataFrame, total: int, limit: float, recall: float) -> DataFrame:
    """vec_id, n, back, root of the links among vectors of one length: by the graph, and if that finds too few by the audit
    even in its widest search, by comparing all with all."""
    clusters = fit_clusters(reps, total)
    sent = reps.sparkSession.sparkContext.broadcast(clusters)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.record_batch([pa.array(sent.value.nearest(block(batch["v"]), OVERLAP).ravel(), pa.int32())], ["cluster"])

    # One count for each cluster: at most MAX_CLUSTERS rows.
    sizes = {r["cluster"]: r["count"] for r in reps.select("v").mapInArrow(homes, "cluster int").groupBy("cluster").count().collect()}
    sizes = [sizes.get(i, 0) for i in range(len(clusters.centers))]
    clusters = Clusters(clusters.centers, tuple(max(1, -(-n // SHARD_ROWS)) for n in sizes), tuple(max(1, -(-2 * n // CHUNK_QUERIES)) for n in sizes))
    shards = build_shards(reps, clusters)
    probes, beam = PROBES, BEAM
    for _ in range(3):
        found = search_shards(reps, shards, clusters, min(probes, len(clusters.centers)), beam, limit)
        if audit(reps, found, total, limit) >= recall:
            return found
        probes, beam = 2 * probes, 2 * beam
    return search_all(reps, total, limit)


def link_vectors(vectors: DataFrame, limit: float = LIMIT, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors(vec_id, embedding, ...)``.

    Two vectors are linked if their cosine, in doubles, is ``limit`` or more; every link that the graph gives
    is computed exactly. Vectors of each length are linked among themselves. Null and
    zero vectors, those with a null or non-finite component, and rows without a vec_id are linked with nothing and kept. Equal
    vectors are one node of the graph, counted as often as they stand in the table; further columns are
    ignored; an empty table gives an empty result. The search is audited against brute force over all rows
    for a bounded sample, vector by vector, and repeated with more probes and a wider beam while it finds too
    few; if the widest does as well, all vectors are compared with all.
    """
    units = materialize(unit_rows(vectors), "units")
    groups = units.groupBy("length", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    members = units.join(groups, ["length", "v"]).select("vec_id", "rep", "weight")
    reps = materialize(groups.select(F.col("rep").alias("vec_id"), "length", "v", "weight"), "reps")
    sizes = {r["length"]: r["count"] for r in reps.groupBy("length").count().collect()}
    out = vectors.select("vec_id")
    if not sizes:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    parts = [found_links(reps.filter(F.col("length") == k).drop("length"), n, limit, recall) for k, n in sorted(sizes.items()) if n > 1]
    found = reduce(DataFrame.union, parts) if parts else reps.select("vec_id", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("back"), F.col("vec_id").alias("root")).limit(0)
    counts = link_counts(found)
    labels = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    facts = members.join(counts.withColumnRenamed("vec_id", "rep"), "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    facts = facts.select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    facts = facts.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return (
        out.join(facts, "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )


def op3_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))
