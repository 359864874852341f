"""Quality of texts: a convolutional network over their bytes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.tables import bounded_sample, table

#: Chunks of CHUNK bytes, each beginning STEP after the one before: a filter's every window lies in one of them.
CHUNK, WIDTH, STRIDE = 256, 8, 2
STEP = CHUNK - WIDTH + STRIDE
BLANK = 256
GOOD = 0.7
AT_ONCE = 256


def chunks_of(text: bytes) -> np.ndarray:
    """Rows of CHUNK bytes that cover the whole text, the last one filled up with BLANK; one row for an empty text."""
    n = max(1, -(-(len(text) - CHUNK) // STEP) + 1)
    codes = np.full((n - 1) * STEP + CHUNK, BLANK, np.int16)
    codes[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(codes, CHUNK)[::STEP]


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class ByteNetwork:
    """Bytes embedded, filters over windows, the largest answer of each filter in a chunk, a logistic unit; a text's
    probability is a logistic unit over the mean, least and greatest of its chunks' answers."""

    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    combine: np.ndarray

    @classmethod
    def new(cls, seed: int, size: int = 8, filters: int = 32) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        wide = lambda *shape, by: rng.normal(0, by, shape).astype(np.float32)
        return cls(wide(257, size, by=0.5), wide(WIDTH * size, filters, by=0.18), np.zeros(filters, np.float32), np.zeros(filters + 1, np.float32), np.array([0, 1, 0, 0], np.float32))

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        x = self.embed[chunks].reshape(len(chunks), -1)
        size = self.embed.shape[1]
        return np.lib.stride_tricks.sliding_window_view(x, WIDTH * size, axis=1)[:, :: STRIDE * size]

    def answers(self, chunks: np.ndarray) -> np.ndarray:
        """The logistic unit's input for each chunk."""
        out = np.empty(len(chunks), np.float32)
        for b in range(0, len(chunks), AT_ONCE):
            some = self.windows(chunks[b : b + AT_ONCE])
            best = (some.reshape(-1, len(self.conv)) @ self.conv).reshape(*some.shape[:2], -1).max(1)
            out[b : b + AT_ONCE] = np.maximum(best + self.bias, 0) @ self.out[:-1] + self.out[-1]
        return out

    def learn(self, chunks: np.ndarray, gold: np.ndarray, step: Adam) -> None:
        some = self.windows(chunks)
        flat = some.reshape(-1, len(self.conv))
        z = (flat @ self.conv).reshape(*some.shape[:2], -1)
        at = z.argmax(1)
        best = np.take_along_axis(z, at[:, None], 1)[:, 0] + self.bias
        pooled = np.maximum(best, 0)
        err = ((logistic(pooled @ self.out[:-1] + self.out[-1]) - gold) / len(gold)).astype(np.float32)
        back = err[:, None] * self.out[:-1] * (best > 0)
        rows = np.arange(len(chunks))[:, None]
        held = some[rows, at]  # chunk, filter, window
        grad_conv = np.einsum("cfw,cf->wf", held, back)
        size = self.embed.shape[1]
        spread = (back[:, :, None] * self.conv.T).reshape(*back.shape, WIDTH, size)
        where = chunks[rows[:, :, None], at[:, :, None] * STRIDE + np.arange(WIDTH)]
        grad_embed = np.stack([np.bincount(where.ravel(), spread[..., j].ravel(), 257) for j in range(size)], 1)
        step.apply([self.embed, self.conv, self.bias, self.out], [grad_embed, grad_conv, back.sum(0), np.append(pooled.T @ err, err.sum())])

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """Of each text, by all its chunks; about AT_ONCE chunks at a time, of a long text too."""
        out = np.empty(len(texts))
        work: list[tuple[int, np.ndarray]] = []
        waiting = 0
        for k, text in enumerate(texts):
            work.append((k, chunks_of((text or "").encode())))
            waiting += len(work[-1][1])
            if waiting >= AT_ONCE or k == len(texts) - 1:
                found = self.answers(work[0][1] if len(work) == 1 else np.concatenate([c for _, c in work]))
                bounds = np.cumsum([0, *(len(c) for _, c in work)])
                for (i, _), a, b in zip(work, bounds, bounds[1:], strict=False):
                    out[i] = logistic(facts(found[a:b]) @ self.combine)
                work, waiting = [], 0
        return out


def facts(answers: np.ndarray) -> np.ndarray:
    return np.array([1, answers.mean(), answers.min(), answers.max()], np.float32)


class Adam:
    def __init__(self, rate: float) -> None:
        self.rate, self.n, self.sums = rate, 0, None

    def apply(self, weights: list[np.ndarray], grads: list[np.ndarray]) -> None:
        self.n += 1
        self.sums = self.sums or [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
        for w, g, (a, b) in zip(weights, grads, self.sums, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= (self.rate * a / (1 - 0.9**self.n) / (np.sqrt(b / (1 - 0.99**self.n)) + 1e-6)).astype(np.float32)


def held_out_quality(doc_id: Column) -> Column:
    """True for the fold that no model may learn from: crc32(doc_id as text) mod 4 is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def labelled_chunks(docs: DataFrame, labels: DataFrame, max_docs: int = 4_000, chunks_each: int = 12) -> list[tuple[np.ndarray, int]]:
    """(chunks, quality) of about ``max_docs`` labelled documents outside the held-out fold, a hash's choice; of a
    long one ``chunks_each`` chunks, evenly over the whole text. So the driver gets 13 MB at most by default."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out_quality(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = bounded_sample(known, "doc_id", max_docs)
    # Of several texts of one doc_id one is learned from, by a hash: partial aggregates leave one a task.
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "quality").agg(F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = []
            for text in part["text"].to_pylist():
                whole = chunks_of(text.encode())
                rows.append(whole[np.unique(np.linspace(0, len(whole) - 1, min(len(whole), chunks_each)).astype(int))].tobytes())
            yield pa.record_batch([part["doc_id"], part["quality"], pa.array(rows, pa.binary())], ["doc_id", "quality", "chunks"])

    cut_rows = texts.select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(cut, "doc_id long, quality int, chunks binary")
    rows = sorted(cut_rows.collect(), key=lambda r: r["doc_id"])
    return [(np.frombuffer(bytes(r["chunks"]), np.int16).reshape(-1, CHUNK), r["quality"]) for r in rows]


def train(examples: list[tuple[np.ndarray, int]], epochs: int = 6, seed: int = 3) -> ByteNetwork:
    """Filters from single chunks of three quarters of the examples, two drawn of each in every epoch; how chunks
    combine, from all chunks of the other quarter. Without both kinds of example every text has their share."""
    net = ByteNetwork.new(seed)
    gold = np.array([y for _, y in examples], np.float32)
    good = (gold.sum() + 1) / (len(gold) + 2)
    net.combine[0] = np.log(good / (1 - good))
    if gold.sum() < 5 or (1 - gold).sum() < 5:
        return net
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(examples))
    rest, fit = order[: len(order) // 4], order[len(order) // 4 :]
    step = Adam(0.01)
    for epoch in range(epochs):
        step.rate = 0.01 / (1 + epoch)
        picked = rng.permutation(np.repeat(fit, 2))
        for some in np.array_split(picked, max(1, len(picked) // 64)):
            net.learn(np.stack([examples[k][0][rng.integers(len(examples[k][0]))] for k in some]), gold[some], step)
    seen = np.stack([facts(net.answers(examples[k][0])) for k in rest])
    weight, mend = np.array([0, 1, 0, 0], np.float32), Adam(0.05)
    for _ in range(400):
        mend.apply([weight], [seen.T @ (logistic(seen @ weight) - gold[rest]).astype(np.float32) / len(rest) + 1e-3 * weight])
    net.combine = weight
    return net


def score_quality(docs: DataFrame, net: ByteNetwork) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: better), predicted (1 from GOOD on) of every row of ``docs(doc_id, text, ...)``.

    Whole texts. A null text is an empty one, which is scored as a chunk of blanks. Repeated rows are scored each for
    itself; a null doc_id counts as an empty decimal; further columns are ignored; an empty table gives an empty
    result. One pass, no shuffle; besides the batch, memory is for AT_ONCE chunks.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = sent.value.probabilities(part["text"].to_pylist())
            yield pa.record_batch([part["doc_id"], part["held_out"], pa.array(found, pa.float64()), pa.array(found >= GOOD).cast(pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out_quality(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(labelled_chunks(docs, table(spark, sf_dir, "labels"))))
