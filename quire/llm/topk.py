"""Exact largest inner products by a dual-tree search over cover trees of queries and data."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.tables import SAMPLE_SPACE, table
from quire.llm.vectors import block, packed, usable
from quire.shared import materialize

K, EVERY = 5, 50
BLOCK_ROWS, CHUNK_QUERIES = 2048, 16_384
DATA_LEAF, QUERY_LEAF, FAN_OUT = 256, 64, 8
SAMPLE_ROWS, MAX_NODES = 4096, 256


@dataclass
class Node:
    """A ball of a cover tree: its points lie within ``radius`` of ``center``, which is one of them."""

    rows: np.ndarray
    center: np.ndarray
    radius: float
    children: list[Node] = field(default_factory=list)
    worst: float = -np.inf

    @property
    def norm(self) -> float:
        return float(np.linalg.norm(self.center))


def cover_tree(points: np.ndarray, rows: np.ndarray, leaf: int, fan_out: int = FAN_OUT) -> Node:
    """Children's centers are picked farthest first until half the radius covers all, at most ``fan_out``;
    where that many don't (points spread in many dimensions), each child keeps its true covering radius."""
    center = points[rows[0]]
    gaps = np.linalg.norm(points[rows] - center, axis=1)
    node = Node(rows, center, float(gaps.max()))
    if len(rows) <= leaf or node.radius == 0:
        return node
    nearest, owner, picked = gaps.copy(), np.zeros(len(rows), dtype=np.int64), 1
    while picked < fan_out and nearest.max() > node.radius / 2:
        at = int(nearest.argmax())
        gap = np.linalg.norm(points[rows] - points[rows[at]], axis=1)
        closer = gap < nearest
        nearest[closer], owner[closer], owner[at] = gap[closer], picked, picked
        picked += 1
    parts = [rows[owner == c] for c in range(picked)]
    node.children = [cover_tree(points, p, leaf, fan_out) for p in parts if len(p)] if sum(map(bool, map(len, parts))) > 1 else []
    return node


class Best:
    """The k best (score, id) of each query so far, better first; equal scores by smaller id."""

    def __init__(self, own: np.ndarray, floors: np.ndarray, k: int):
        self.own, self.floors, self.k = own, floors, k
        self.scores = np.full((len(own), k), -np.inf)
        self.ids = np.full((len(own), k), np.iinfo(np.int64).max)

    def worst(self, rows: np.ndarray) -> float:
        """A score that some query of ``rows`` still has to reach, at least."""
        return float(np.maximum(self.scores[rows, -1], self.floors[rows]).min())

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.where(ids[None] == self.own[rows][:, None], -np.inf, scores)
        better = np.flatnonzero((scores >= np.maximum(self.scores[rows, -1], self.floors[rows])[:, None]).any(1))
        if not len(better):
            return
        rows, scores = rows[better], scores[better]
        if scores.shape[1] > 8 * self.k:  # only scores that reach the kth can count; ties stay
            kth = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1]
            columns = np.flatnonzero((scores >= kth[:, None]).any(0))
            scores, ids = scores[:, columns], ids[columns]
        every = np.concatenate([self.scores[rows], scores], 1)
        names = np.concatenate([self.ids[rows], np.broadcast_to(ids, scores.shape)], 1)
        order = np.lexsort((names, -every), axis=1)[:, : self.k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(every, order, 1), np.take_along_axis(names, order, 1)


def bound(q: Node, d: Node) -> float:
    """No inner product of a point of ``q`` and one of ``d`` is larger."""
    top = float(q.center @ d.center) + q.norm * d.radius + d.norm * q.radius + q.radius * d.radius
    return top + 1e-9 * abs(top) + 1e-6


def dual_search(q: Node, d: Node, queries: np.ndarray, data: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """Compare all pairs of points of two nodes but those that can't reach their queries' worst kth score."""
    if bound(q, d) < best.worst(q.rows):
        return
    if not q.children and not d.children:
        best.offer(q.rows, queries[q.rows] @ data[d.rows].T, ids[d.rows])
    elif d.children and (not q.children or d.radius >= q.radius):
        for part in sorted(d.children, key=lambda x: -bound(q, x)):
            dual_search(q, part, queries, data, ids, best)
    else:
        for part in q.children:
            dual_search(part, d, queries, data, ids, best)


@dataclass(frozen=True)
class Top:
    """The top of the tree, from a bounded sample: for each vector length, centers, and sample rows whose
    scores are floors of what a query's kth best score can be."""

    centers: dict[int, np.ndarray]
    sample: dict[int, tuple[np.ndarray, np.ndarray]]

    def nodes(self, rows: np.ndarray) -> np.ndarray:
        centers = self.centers.get(rows.shape[1])
        if centers is None:
            return np.zeros(len(rows), dtype=np.int64)
        return ((centers**2).sum(1)[None] - 2 * rows @ centers.T).argmin(1)

    def floors(self, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
        """The kth best score of each row among the sample rows of other ids."""
        known, sample = self.sample.get(rows.shape[1], (np.zeros(0, dtype=np.int64), np.zeros((0, rows.shape[1]))))
        if len(known) < k:
            return np.full(len(rows), -np.inf)
        scores = np.where(ids[:, None] == known[None], -np.inf, rows @ sample.T)
        return -np.partition(-scores, k - 1, axis=1)[:, k - 1]


def fit_top(valid: DataFrame, total: int) -> Top:
    """From about SAMPLE_ROWS rows, by a hash of their ids; at most MAX_NODES centers a length."""
    share = SAMPLE_SPACE if total <= SAMPLE_ROWS else max(1, SAMPLE_ROWS * SAMPLE_SPACE // total)
    found = valid.filter(F.pmod(F.xxhash64(F.lit(29), "vec_id"), F.lit(SAMPLE_SPACE)) < share).orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * SAMPLE_ROWS).collect()
    centers, sample = {}, {}
    for length in {len(r["v"]) for r in found}:
        ids = np.array([r["vec_id"] for r in found if len(r["v"]) == length])
        rows = np.array([r["v"] for r in found if len(r["v"]) == length], dtype=np.float64)
        picked, nearest = [0], np.linalg.norm(rows - rows[0], axis=1)
        while len(picked) < min(MAX_NODES, 1 + total // BLOCK_ROWS) and nearest.max() > 0:
            picked.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, np.linalg.norm(rows - rows[picked[-1]], axis=1))
        centers[length], sample[length] = rows[picked], (ids, rows)
    return Top(centers, sample)


def assign(valid: DataFrame, top: Top, k: int, every: int) -> DataFrame:
    """length, node, vec_id, v (packed doubles) and, for queries, the floor of the kth best score."""
    sent = valid.sparkSession.sparkContext.broadcast(top)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch["v"].value_lengths().to_numpy()
            for length in np.unique(lengths):
                part = batch.take(pa.array(np.flatnonzero(lengths == length)))
                ids, rows = part["vec_id"].to_numpy(), part["v"].flatten().to_numpy().reshape(len(part), length)
                floors, asks = np.full(len(ids), -np.inf), np.flatnonzero(ids % every == 0)
                floors[asks] = sent.value.floors(ids[asks], rows[asks], k)
                yield pa.record_batch([pa.array(np.full(len(ids), length, dtype=np.int32)), pa.array(sent.value.nodes(rows).astype(np.int32)), part["vec_id"], packed(rows), pa.array(floors)], ["length", "node", "vec_id", "v", "floor"])

    return valid.mapInArrow(work, "length int, node int, vec_id long, v binary, floor double")


def blocks_of(assigned: DataFrame) -> DataFrame:
    """One row for each block: the ids and vectors of about BLOCK_ROWS rows of one top node, by a hash."""

    def pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        columns = rows["vec_id"].to_numpy().astype("<i8"), block(rows["v"].combine_chunks())
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in columns)], ["length", "ids", "points"])

    # One row for each length and top node: bounded by MAX_NODES a length.
    sizes = assigned.groupBy("length", "node").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    placed = assigned.join(F.broadcast(sizes), ["length", "node"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), "blocks"))
    return materialize(placed.select("length", "node", "part", "vec_id", "v").groupBy("length", "node", "part").applyInArrow(pack, "length int, ids binary, points binary"), "blocks")


@dataclass(frozen=True)
class Queries:
    """Queries of one length, numbered, with their tree."""

    numbers: np.ndarray
    own: np.ndarray
    floors: np.ndarray
    points: np.ndarray
    tree: Node


def queries_of(rows: pa.Table) -> dict[int, Queries]:
    out = {}
    for length in rows["length"].unique().to_pylist():
        part = rows.filter(pc.equal(rows["length"], length))
        points = block(part["v"].combine_chunks())
        tree = cover_tree(points, np.arange(len(points)), QUERY_LEAF)
        out[length] = Queries(part["number"].to_numpy(), part["vec_id"].to_numpy(), part["floor"].to_numpy(), points, tree)
    return out


def answers(blocks: DataFrame, asked: pa.Table, k: int) -> DataFrame:
    """number, query_id, vec_id, score: for each task's blocks the best of each of the ``asked`` queries, which are
    broadcast: CHUNK_QUERIES of them or so. The kth best so far rules out nodes of all later blocks of a task."""
    sent = blocks.sparkSession.sparkContext.broadcast(asked)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = queries_of(sent.value)
        best = {length: Best(q.own, q.floors, k) for length, q in queries.items()}
        for batch in batches:
            for row in batch.to_pylist():
                q = queries.get(row["length"])
                if q is not None:
                    ids, points = np.frombuffer(row["ids"], dtype="<i8"), np.frombuffer(row["points"], dtype="<f8").reshape(-1, row["length"])
                    dual_search(q.tree, cover_tree(points, np.arange(len(points)), DATA_LEAF), q.points, points, ids, best[row["length"]])
        for length, q in queries.items():
            rows, columns = np.nonzero(np.isfinite(best[length].scores))
            found = q.numbers[rows], q.own[rows], best[length].ids[rows, columns], best[length].scores[rows, columns].astype(np.int64)
            yield pa.record_batch([*map(pa.array, found)], ["number", "query_id", "vec_id", "score"])

    return blocks.mapInArrow(search, "number long, query_id long, vec_id long, score long")


def top_products(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows with the largest inner product with each query.

    ``vectors(vec_id, embedding, ...)``: components x count as floor(256 * x). Queries are the rows whose
    vec_id is divisible by ``every``; candidates are all rows with another vec_id and as many components;
    equal scores go to the smaller vec_id. Rows without a vec_id, and vectors that are null, empty or hold a
    null or non-finite component, take no part; repeated rows count as candidates as often as they stand there, and
    ask once; different vectors of one query id are ranked each for itself; further columns are ignored; an empty
    table, or one without queries, gives no row. Scores are exact as long as the sum of the products' sizes stays
    below 2**53.

    Rows go to the nearest top node, then to blocks of about BLOCK_ROWS by a hash, so no node is one task: one
    shuffle, in proportion to the rows. The queries, CHUNK_QUERIES at a time, are sent to all tasks and searched
    against all blocks, tree against tree; only the best of each task are shuffled.
    """
    spark = vectors.sparkSession
    valid = vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    valid = valid.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("v"))
    total = valid.count()
    assigned = materialize(assign(valid, fit_top(valid, total), k, every), "assigned")
    blocks = blocks_of(assigned)
    queries = assigned.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]).withColumn("number", F.monotonically_increasing_id())
    queries = materialize(queries.select("number", "vec_id", "length", "v", "floor"), "queries")
    chunks = -(-queries.count() // CHUNK_QUERIES)
    place, parts = F.pmod(F.xxhash64("number"), F.lit(max(1, chunks))), []
    for c in range(chunks):
        found = answers(blocks, queries.filter(place == c).toArrow(), k)
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")))
        parts.append(materialize(ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "ranked"))
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


def op4_sql() -> str:
    usable_sql = "vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0"
    return f"""
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings WHERE {usable_sql}),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id % {EVERY} = 0 AND d.vec_id <> q.vec_id AND len(d.e) = len(q.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""
