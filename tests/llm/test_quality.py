"""The byte network: held-out accuracy on the given tables, whole texts, and a plain forward pass."""

from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import quality


def fold(doc_id):
    return crc32(b"" if doc_id is None else str(doc_id).encode()) % 4 == 2


@pytest.fixture(scope="module")
def net(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    return quality.train(quality.labelled_chunks(docs, labels))


def plain_score(net, text):
    """Window by window."""
    data = (text or "").encode()
    n = max(1, -(-(len(data) - quality.CHUNK) // quality.STEP) + 1)
    answers = []
    for c in range(n):
        chunk = list(data[c * quality.STEP : c * quality.STEP + quality.CHUNK])
        chunk += [quality.BLANK] * (quality.CHUNK - len(chunk))
        best = np.full(len(net.bias), -np.inf)
        for w in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
            best = np.maximum(best, np.concatenate([net.embed[b] for b in chunk[w : w + quality.WIDTH]]) @ net.conv)
        answers.append(np.maximum(best + net.bias, 0) @ net.out[:-1] + net.out[-1])
    z = net.combine @ np.array([1, np.mean(answers), np.min(answers), np.max(answers)])
    return 1 / (1 + np.exp(-z))


def test_held_out_quality(spark, net):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score_quality(docs, net).filter("held_out").join(labels.filter("quality IS NOT NULL"), "doc_id").collect()
    assert all(fold(r["doc_id"]) for r in rows) and len(rows) > 500
    y, p = np.array([r["quality"] for r in rows]), np.array([r["score"] for r in rows])
    rank = p.argsort().argsort()
    ones, zeros = y.sum(), (1 - y).sum()
    assert (rank[y == 1].sum() - ones * (ones - 1) / 2) / (ones * zeros) > 0.97
    assert (np.array([r["predicted"] for r in rows]) == y).mean() > 0.97
    assert all(r["predicted"] == (r["score"] >= quality.GOOD) for r in rows)


def test_scores_equal_a_plain_pass(net):
    texts = [None, "", "a", "Über uns!!! ", "plain words come here and go " * 40, "THE!! OF!! " * 60, "x" * quality.CHUNK, "y" * (quality.CHUNK + 1)]
    found = net.probabilities(texts)
    assert np.allclose(found, [plain_score(net, t) for t in texts], atol=1e-4)
    assert np.allclose(found, [net.probabilities([t])[0] for t in texts], atol=1e-5)


def test_chunks_cover_every_window():
    for n in (0, 1, 255, 256, 257, quality.STEP + quality.CHUNK, 3000):
        text = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
        chunks = quality.chunks_of(text)
        seen = {bytes(c[w : w + quality.WIDTH].astype(np.uint8)) for c in chunks for w in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE) if c[w + quality.WIDTH - 1] != quality.BLANK}
        assert {text[w : w + quality.WIDTH] for w in range(0, n - quality.WIDTH + 1, quality.STRIDE)} <= seen
        joined = bytes(chunks[0].astype(np.int16)[chunks[0] != quality.BLANK].astype(np.uint8)) if len(chunks) == 1 else None
        assert joined in (None, text)


def test_a_passage_deep_in_a_long_text_counts(net):
    """A text of a megabyte is scored by all of it."""
    good = "with the hand over the of and there is one more that was not in " * 16_000
    assert net.probabilities([good])[0] != net.probabilities([good + "RE!! THE!! OF!! AND!! " * 20_000])[0]


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    net = quality.ByteNetwork.new(1, size=3, filters=4)
    for part in (net.embed, net.conv, net.bias, net.out):
        part += rng.normal(0, 0.3, part.shape).astype(np.float32)
    for name in ("embed", "conv", "bias", "out"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    chunks, gold = rng.integers(0, 20, (6, 40)).astype(np.int16), rng.integers(0, 2, 6)

    def loss():
        some = net.windows(chunks)
        best = (some.reshape(-1, len(net.conv)) @ net.conv).reshape(*some.shape[:2], -1).max(1)
        p = quality.logistic(np.maximum(best + net.bias, 0) @ net.out[:-1] + net.out[-1])
        return -np.mean(gold * np.log(p) + (1 - gold) * np.log(1 - p))

    kept = {}
    net.learn(chunks, gold, type("Keep", (), {"apply": lambda self, weights, grads: kept.update(zip(("embed", "conv", "bias", "out"), grads, strict=True))})())
    for name, grad in kept.items():
        part = getattr(net, name)
        for at in {tuple(int(rng.integers(n)) for n in part.shape) for _ in range(8)}:
            before = part[at]
            part[at] = before + 1e-5
            high = loss()
            part[at] = before - 1e-5
            assert abs((high - loss()) / 2e-5 - grad[at]) < 1e-3, (name, at)
            part[at] = before


def test_awkward_and_empty_tables(spark, net, awkward, no_documents):
    docs = awkward.withColumnsRenamed({"node": "score", "n": "quality", "ids": "held_out", "spans": "predicted"}).unionByName(spark.createDataFrame([(None, "a b c")], "doc_id long, text string"), allowMissingColumns=True)
    rows = quality.score_quality(docs, net).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["held_out"] == fold(r["doc_id"]) for r in rows)
    same = {r["doc_id"]: r["score"] for r in rows}
    assert abs(same[9] - same[10]) < 1e-6 and same[1] == pytest.approx(same[2])
    assert quality.score_quality(no_documents, net).collect() == []
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score_quality(docs, quality.train(quality.labelled_chunks(docs, none))).collect()} == {0.5}


def test_learns_from_the_open_folds_alone(spark):
    """Labels of the held-out fold, null ones and those without a document change nothing; of several texts of an
    id one is taken."""
    docs = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(40)] + [(0, "another")] * 3 + [(41, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(42)] + [(None, 1, 0), (1, None, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality.labelled_chunks(docs, labels)
    assert len(found) == sum(not fold(i) for i in [*range(40), 41])
    changed = labels.withColumn("quality", F.when(quality.held_out_quality(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert all((a == c).all() and b == d for (a, b), (c, d) in zip(found, quality.labelled_chunks(docs, changed), strict=True))
    assert len(quality.labelled_chunks(docs, labels, max_docs=10)) < 25
