"""Ranked search against a plain scorer."""

import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from quire.llm import ranked

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return PLAIN.findall((text or "").translate(LOWER))


def plain_ranks(docs, items, k=10):
    counts = [(d, Counter(plain_terms(t))) for d, t in docs if plain_terms(t)]
    total, all_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 25 + (75 * sum(c.values()) * total) // all_terms
            score = sum(n * floor(1000 * log((2 * total + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, n in Counter(plain_terms(text)).items() if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, k=10):
    return sorted(map(tuple, ranked.rank_documents(docs, items, k).collect()), key=str)


def test_terms_are_those_of_the_contract(awkward):
    for r in awkward.collect():
        assert [t.decode() for t in ranked.terms_of(r["text"])] == plain_terms(r["text"])


def test_awkward_tables(spark, awkward, no_documents):
    """Null, empty, long and repeated texts, rows without an id, repeated items, columns of the result's names."""
    docs = awkward.withColumnsRenamed({"node": "score", "n": "rank", "ids": "m"}).unionByName(spark.createDataFrame([(None, "words come again"), (None, "words come again")], "doc_id long, text string"), allowMissingColumns=True)
    asked = [(1, "the same WORDS again again"), (2, None), (3, " . "), (4, "éß kelvin Kelvin x"), (4, "card"), (1, "the same WORDS again again"), (None, "words come"), (5, "nowhere found")]
    items = spark.createDataFrame([(i, t, 0) for i, t in asked], "item_id long, text string, doc_id int")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(spark, docs, items) == plain_ranks(rows, dict.fromkeys(asked))
    assert found(spark, docs, items, 2) == plain_ranks(rows, dict.fromkeys(asked), 2)
    assert found(spark, no_documents, items) == [] and found(spark, docs, items.filter("item_id > 9")) == []


def test_blocks_of_queries_and_small_batches(spark, sf_dir, some_documents, monkeypatch):
    """The same rows from many blocks, index partitions and batches, whatever is pruned."""
    docs, texts = some_documents
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    asked = [(r["item_id"], r["text"]) for r in items.collect()]
    monkeypatch.setattr(ranked, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(ranked, "SHARD_ROWS", 20)
    monkeypatch.setattr(ranked, "DOCS_AT_ONCE", 2)
    monkeypatch.setattr(ranked, "TERMS_AT_ONCE", 3)
    assert found(spark, docs, items, 3) == plain_ranks(list(texts.items()), asked, 3)


@pytest.mark.parametrize("seed", range(6))
def test_strata_prune_without_loss(seed):
    """Bounds hold, strata beyond the k-th best aren't scored, and what is kept is the best of all."""
    rng = np.random.default_rng(seed)
    n, n_terms, k = 400, 30, 5
    m = rng.choice([30, 31, 80, 100, 4000], n)
    sizes = rng.integers(0, 8, n)
    terms = np.concatenate([rng.choice(n_terms, s, replace=False) for s in sizes]).astype(np.int32)
    tfs, weights = rng.integers(1, 4, len(terms)), rng.integers(0, 5000, n_terms)
    texts = [" ".join(f"t{t}" for t in rng.choice(n_terms, 4)) for _ in range(7)]
    queries, vocabulary = ranked.Queries.of(texts)
    number = np.array([vocabulary.get(b"t%d" % t, -1) for t in range(n_terms)])
    keep = number[terms] >= 0
    owner = np.repeat(np.arange(n), sizes)
    strata = ranked.Strata.build(m, np.arange(n), np.zeros(n, bool), np.bincount(owner[keep], minlength=n), number[terms[keep]].astype(np.int32), tfs[keep], weights[: len(vocabulary)])
    impact = weights[: len(vocabulary)][number[terms[keep]]] * (1_000_000_000 * tfs[keep] // (1000 * tfs[keep] + 8 * m[owner[keep]]))
    dense = np.zeros((n, len(vocabulary)), np.int64)
    dense[owner[keep], number[terms[keep]]] = impact
    times = np.zeros((len(vocabulary), len(texts)), np.int64)
    times[queries.terms, queries.owners] = queries.times
    scores = dense @ times
    bounds = strata.bounds(queries, len(vocabulary))
    for s, norm in enumerate(strata.norms):
        assert (scores[m == norm] <= bounds[s]).all()
    scored = []
    plain = strata.scores
    object.__setattr__(strata, "scores", lambda s, *a: scored.append(s) or plain(s, *a))
    best = ranked.Best(k, [[] for _ in texts])
    strata.search(queries, len(vocabulary), best)
    for q, rows in enumerate(best.rows):
        assert rows == sorted((-v, False, d) for d, v in enumerate(scores[:, q].tolist()) if v > 0)[:k]
    assert len(set(scored)) < len(strata.norms)


def test_products_beyond_doubles():
    a, b = np.array([[2**40, 3]]), np.array([[2**20], [1]])
    assert ranked.exact_product(a, b).tolist() == [[2**60 + 3]]
