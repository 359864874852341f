"""Periodic runs against a search of every period at every place."""

from hashlib import sha256

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import runs


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1 if j == i else j
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_row(doc_id, text, change):
    split = runs.WORD.findall(text or "")
    words = [split[k] for k in change(np.arange(len(split)), doc_id)]
    found = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    facts = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(found), *facts, sha256(listed.encode()).hexdigest(), sha256(left.encode()).hexdigest()


blocks = st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=8), st.integers(1, 9), st.lists(st.integers(0, 3), max_size=4)).map(lambda b: b[0] * b[1] + b[2])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(blocks, max_size=6).map(lambda bs: [w for b in bs for w in b]), max_size=5))
def test_runs_of_equal_a_plain_search(documents):
    doc, *facts = runs.runs_of([np.array(d, dtype=np.int32) for d in documents])
    found = [[] for _ in documents]
    for d, *run in zip(doc, *facts, strict=True):
        found[d].append(tuple(run))
    assert [sorted(f) for f in found] == [plain_runs(d) for d in documents]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=2, max_size=300), st.data())
def test_extensions_equal_a_plain_comparison(words, data):
    ext = runs.Extensions(np.array([*words, 2], dtype=np.int32))
    i = data.draw(st.integers(0, len(words) - 2))
    j = data.draw(st.integers(i + 1, len(words) - 1))
    n = 0
    while j + n < len(words) and words[i + n] == words[j + n]:
        n += 1
    assert ext.of(np.array([i]), np.array([j])).tolist() == ext.of(np.array([j]), np.array([i])).tolist() == [n]


def test_cover_meets_every_distance():
    assert {(b - a) % runs.PERIOD for a in runs.COVER for b in runs.COVER} == set(range(runs.PERIOD))


def test_greatest_exponent_is_exact():
    """Exponents that no double tells apart."""
    n = 10**9
    assert runs.strongest([(0, 10 * n + 1, n), (5, 10 * n - 9, n - 1)]) == (5, 10 * n - 9, n - 1)
    assert runs.strongest([(0, 8, 2), (9, 4, 1)]) == (0, 8, 2) and runs.strongest([]) is None


def test_documents_as_by_brute_force(spark, sf_dir, some_documents):
    _, texts = some_documents
    found = {r["doc_id"]: tuple(r) for r in runs.op12_runs(spark, sf_dir).collect()}
    assert found == {d: plain_row(d, t, runs.looped) for d, t in texts.items()}
    assert sum(r[1] > 0 for r in found.values()) >= 10


def test_awkward_rows_and_empty_tables(spark, awkward, no_documents):
    """Null, empty, blank, long and repeated texts, columns of the result's own names, no rows, rows without an id."""
    docs = awkward.withColumnsRenamed({"node": "start", "n": "period"})
    whole = lambda words, doc_id: words
    short = "doc_id NOT IN (9, 10)"
    for change in (whole, runs.looped):
        found = sorted(map(tuple, runs.find_runs(docs, change).filter(short).collect()), key=str)
        assert found == sorted((plain_row(r["doc_id"], r["text"], change) for r in docs.filter(short).collect()), key=str)
    by_id = {r["doc_id"]: r for r in runs.find_runs(docs).collect()}
    assert tuple(by_id[9])[1:6] == (1, 0, 24000, 6, 4_000_000) and by_id[1]["n_runs"] == by_id[2]["n_runs"] == 0
    assert by_id[1]["collapsed_sha256"] == by_id[3]["runs_sha256"] == sha256(b"").hexdigest()
    assert runs.find_runs(no_documents).collect() == []
    lost = spark.createDataFrame([(None, "a b c " * 40), (None, "a b c " * 40)], "doc_id long, text string")
    assert [tuple(r) for r in runs.find_runs(lost, runs.looped).collect()] == [plain_row(None, "a b c " * 40, runs.looped)] * 2


def test_a_long_text(spark):
    """300,000 words: one word over and over, then a cycle of seven."""
    text = "w " * 200_000 + "a b c d e f g " * 15_000
    [row] = runs.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert tuple(row)[1:6] == (2, 0, 200_000, 1, 200_000_000)
