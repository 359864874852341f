"""Near duplicates, vector links, top-k and language against brute force."""

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import graph, language, near_dup, shingles, topk, url_filter
from quire.llm.components import components
from quire.llm.graph import op3_graph
from quire.llm.language import op9_language_id
from quire.llm.near_dup import op10_near_dup
from quire.llm.topk import op4_topk

from .conftest import AWKWARD


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(100)], [(0, i) for i in range(1, 50)] + [(60, 61), (61, 62), (62, 60)], [(i, 2 * i) for i in range(1, 80)]])
def test_components(spark, links):
    frame = spark.createDataFrame(links, "a long, b long")
    found = {r["node"]: r["component"] for r in components(frame).collect()}
    nodes = {n for a, b in links for n in (a, b) if a != b}
    assert found == roots(nodes, [x for x in links if x[0] != x[1]])


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def plain_near_dup(texts):
    sets = {d: shingle_set(t) for d, t in texts.items()}
    holders = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            holders[x].add(d)
    links = set()
    for d, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for o in holders[x]:
                if o < d:
                    shared[o] += 1
        links |= {(o, d) for o, n in shared.items() if 100 * n >= 75 * (len(s) + len(sets[o]) - n)}
    return {d: len(s) for d, s in sets.items()}, roots(sets, links)


def same_as_plain(rows, texts):
    sizes, component = plain_near_dup(texts)
    for r in rows:
        d = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (sizes[d], component[d], component[d] == d), d


def test_op10_equals_brute_force(spark, some_documents, sf_dir):
    rows = op10_near_dup(spark, sf_dir).collect()
    assert len(rows) == len(some_documents[1])
    same_as_plain(rows, some_documents[1])


def test_op10_equals_brute_force_at_sf001(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    same_as_plain(near_dup.near_duplicates(docs).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})


def hot_texts():
    """A crowd of near copies, a passage that most documents hold, chains, and pairs at the limit."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(5000)]
    draw = lambda n: rng.choice(words, n).tolist()
    base, passage, texts = draw(150), draw(60), {}
    for _ in range(300):
        copy = list(base)
        for at in rng.integers(0, 150, 2):
            copy[at] = "changed" + str(rng.integers(10**6))
        texts[len(texts)] = " ".join(copy)
    for _ in range(300):
        texts[len(texts)] = " ".join(draw(40) + passage + draw(40))
    link = draw(200)
    for _ in range(20):
        at = rng.integers(0, 190)
        link = link[:at] + draw(3) + link[at + 3 :]
        texts[len(texts)] = " ".join(link)
    for _ in range(100):
        start = draw(104)
        texts[len(texts)] = " ".join(start)
        texts[len(texts)] = " ".join(start[:89] + draw(15))
    for _ in range(30):
        texts[len(texts)] = texts[0]
    return texts


def test_op10_on_hot_groups(spark):
    texts = hot_texts()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    same_as_plain(near_dup.near_duplicates(docs).collect(), texts)


def test_op10_awkward_and_empty(spark, awkward, no_documents):
    rows = near_dup.near_duplicates(awkward).collect()
    assert len(rows) == len(AWKWARD)
    same_as_plain(rows, dict(AWKWARD))
    assert near_dup.near_duplicates(no_documents).collect() == []
    lost = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(lost).collect()} == {(None, 2, None, True), (1, 2, 1, True)}


def test_op10_judges_rows_of_one_id_by_their_own_text(spark):
    first, second = "a b c d e f g h", "nothing of the other text is here at all"
    rows = [(1, first), (2, first), (2, second), (2, second), (3, second + " "), (3, None), (4, "one two three four five six")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs).collect())
    assert found == [(1, 4, 1, True), (2, 4, 1, False), (2, 5, 2, True), (2, 5, 2, True), (3, 0, 3, True), (3, 5, 2, False), (4, 2, 4, True)]


def test_shingles_of_any_slice_are_the_same():
    import pyarrow as pa

    texts = [t or "" for _, t in AWKWARD] + ["É é a\x0bB", "\x1f x \xa0 y z w"]
    whole = shingles.shingle_sets(shingles.plain(pa.array(texts)))
    for i, text in enumerate(texts):
        alone = shingles.shingle_sets(shingles.plain(pa.array([text])))
        assert alone.values.tolist() == whole.values[whole.bounds[i] : whole.bounds[i + 1]].tolist()
        assert len(alone.values) == len(shingle_set(text))


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, weight int, v string")


def plain_links(rows, limit=0.9):
    ok = {i: np.array(v, dtype=np.float64) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = sorted(ok)
    unit = np.stack([ok[i] / np.linalg.norm(ok[i]) for i in ids])
    hit = unit @ unit.T >= limit
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(hit), strict=True) if a < b]
    counts = dict(zip(ids, hit.sum(1) - 1, strict=True))
    component = roots([i for i, _ in rows], links)
    return {i: (int(counts.get(i, 0)), component[i], component[i] == i) for i, _ in rows}


def hot_vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    rows = [rng.normal(size=16) for _ in range(1500)]
    rows += [base + 0.05 * rng.normal(size=16) for _ in range(1700)]
    rows += [base] * 400
    rows += [r + 0.08 * rng.normal(size=16) for r in rows[:300]]
    return [(i, np.float32(r).tolist()) for i, r in enumerate(rows)]


def recall_of(found, true):
    total = sum(t[0] for t in true.values())
    assert all(found[i][0] <= t[0] for i, t in true.items())
    return sum(found[i][0] for i in true) / total if total else 1.0


def as_dict(frame):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in frame.collect()}


def planted_vectors(rows):
    """Links set among given vectors: partners a little over and a little under the limit, chains, a crowd that fills
    several shards of one cluster, copies under other ids."""
    rng = np.random.default_rng(17)
    unit = lambda v: v / np.linalg.norm(v)
    given = [unit(np.array(v, dtype=np.float64)) for _, v in rows]

    def at(v, cosine):
        side = rng.normal(size=len(v))
        return cosine * v + np.sqrt(1 - cosine**2) * unit(side - (side @ v) * v)

    made = [at(v, c) for v in given[:200] for c in (0.905, 0.895)]
    for v in given[200:220]:
        for _ in range(6):
            v = at(v, 0.93)
            made.append(v)
    made += [at(given[300], 0.97) for _ in range(3 * graph.SHARD_ROWS)]
    made += [3 * v for v in given[400:450]]
    start = 1 + max(i for i, _ in rows)
    return rows + [(start + k, np.float32(v).tolist()) for k, v in enumerate(made)]


def test_op3_equals_brute_force(spark):
    """On the given vectors, which hold no link, and on the same with links planted among them."""
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    true, found = plain_links(rows), as_dict(op3_graph(spark, "/root/testdata/sf0.1"))
    assert found == true and not any(t[0] for t in true.values())
    rows = planted_vectors(rows)
    true, found = plain_links(rows), as_dict(graph.link_vectors(vectors(spark, rows)))
    few = {i for i, t in true.items() if 0 < t[0] <= 8}
    assert found.keys() == true.keys() and len(few) > 500 and max(t[0] for t in true.values()) > 4000
    assert recall_of(found, true) >= 0.95 and recall_of({i: found[i] for i in few}, {i: true[i] for i in few}) >= 0.95
    assert sum(found[i][1] == t[1] for i, t in true.items()) >= 0.98 * len(true)
    joined = {i for i, f in found.items() if f[1] != i} | {f[1] for i, f in found.items() if f[1] != i}
    assert all((found[i][0] > 0) == (i in joined) for i in found)


def test_op3_on_hot_groups(spark):
    rows = hot_vectors()
    true, found = plain_links(rows), as_dict(graph.link_vectors(vectors(spark, rows)))
    assert found.keys() == true.keys() and recall_of(found, true) >= 0.95
    assert sum(found[i][1] == t[1] for i, t in true.items()) >= 0.98 * len(true)


def test_op3_awkward_and_empty(spark):
    odd = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [3.0, 4.0]), (7, [6.0, 8.0]), (8, [3.0, 4.0]), (9, [-3.0, -4.0]), (10, []), (11, [1.0, 0.0, 0.0]), (12, [1e30, 1e30]), (13, [1e-30, 1e-30])]
    found = as_dict(graph.link_vectors(vectors(spark, odd)))
    linked = {6: (4, 6, True), 7: (4, 6, False), 8: (4, 6, False), 12: (4, 6, False), 13: (4, 6, False)}
    assert found == {i: linked.get(i, (0, i, True)) for i, _ in odd}
    empty = vectors(spark, [])
    assert graph.link_vectors(empty).collect() == []
    assert as_dict(graph.link_vectors(vectors(spark, [(1, None)]))) == {1: (0, 1, True)}
    none = spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert as_dict(graph.link_vectors(none)) == {None: (0, None, True), 1: (0, 1, True)}


def plain_top(rows, k=5, every=50):
    ok = [(i, np.floor(256 * np.array(v, dtype=np.float64))) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    out = []
    for q, v in ok:
        if q % every == 0:
            scores = sorted((-int(v @ w), i) for i, w in ok if i != q and len(v) == len(w))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def top_rows(frame):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in frame.collect())


def test_op4_equals_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert top_rows(op4_topk(spark, sf_dir)) == plain_top(rows)


def test_op4_on_hot_groups_and_awkward(spark):
    rows = hot_vectors()
    assert top_rows(topk.top_products(vectors(spark, rows))) == plain_top(rows)
    odd = [(0, [1.0, 1.0]), (50, [0.5, -2.0]), (100, None), (150, [1.0, None]), (200, [float("nan"), 1.0]), (250, []), (300, [1.0, 2.0, 3.0]), (3, [1.0, 1.0]), (2, [1.0, 1.0]), (4, [-1.0, 0.0]), (-50, [0.0, 0.0]), (5, [1.0, 2.0, 3.0])]
    assert top_rows(topk.top_products(vectors(spark, odd))) == plain_top(odd)
    twice = [(0, [1.0, 1.0]), (0, [1.0, 1.0]), (0, [-1.0, 0.5])] + [(i, [float(i), 1.0]) for i in range(1, 8)]
    once = sorted(plain_top(twice[1:2] + twice[3:]) + plain_top(twice[2:]))
    assert top_rows(topk.top_products(vectors(spark, twice))) == once
    assert topk.top_products(vectors(spark, [])).collect() == []
    assert topk.top_products(vectors(spark, [(1, [1.0])])).collect() == []


def test_dual_search_prunes_clustered_points():
    rng = np.random.default_rng(9)
    data = np.floor(256 * (rng.normal(size=(12, 8))[rng.integers(0, 12, 4000)] * 3 + 0.02 * rng.normal(size=(4000, 8))))
    queries, ids = data[::50], np.arange(4000)
    best = topk.Best(ids[::50], np.full(80, -np.inf), 5)
    seen = []
    offer = best.offer
    best.offer = lambda rows, scores, names: (seen.append(scores.size), offer(rows, scores, names))
    topk.dual_search(topk.cover_tree(queries, np.arange(80), 8), topk.cover_tree(data, ids, 64), queries, data, ids, best)
    assert sum(seen) < 0.5 * 80 * 4000
    for i, q in enumerate(queries):
        scores = sorted((-int(q @ w), j) for j, w in enumerate(data) if j != 50 * i)[:5]
        assert [(-int(s), int(j)) for s, j in zip(best.scores[i], best.ids[i], strict=True)] == scores


def test_op9_predicts_held_out_languages(spark):
    from zlib import crc32

    rows = op9_language_id(spark, "/root/testdata/sf0.01").collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def plain_language(model, text):
    """The score word by word, in plain Python."""
    from math import exp

    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not any(c.isalpha() for w in words for c in w):
        return "und", 0.0
    total = [0.0] * len(model.languages)
    for w in words:
        if w in model.words:
            row = [float(x) for x in model.word_log[model.words[w]]]
        else:
            row = [0.0] * len(total)
            for n in (4, 3, 2, 1):
                padded = f"^{w}$" if n > 1 else w
                known = [model.grams[n][padded[i : i + n]] for i in range(len(padded) - n + 1) if padded[i : i + n] in model.grams[n]]
                if known:
                    row = [sum(float(model.gram_log[n][k][j]) for k in known) / len(known) for j in range(len(total))]
                    break
        total = [a + b for a, b in zip(total, row, strict=True)]
    odds = [exp((t - max(total)) * min(1.0, 50 / len(words))) for t in total]
    best = max(range(len(odds)), key=lambda j: odds[j])
    return model.languages[best], odds[best] / sum(odds)


def test_op9_equals_a_plain_scorer(some_documents, awkward):
    docs, texts = some_documents
    model = language.train(language.learnable(docs))
    rows = language.identify(docs, model).collect() + language.identify(awkward, model).collect()
    texts = texts | dict(AWKWARD)
    for r in rows:
        if r["doc_id"] in dict(AWKWARD) and r["doc_id"] in dict(some_documents[1]):
            continue
        lang, score = plain_language(model, texts[r["doc_id"]])
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-3, r["doc_id"]


def test_op9_learns_nothing_from_the_held_out(spark, some_documents):
    docs = some_documents[0]
    moved = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert "xx" not in language.train(language.learnable(moved)).languages


def test_op9_awkward_and_empty(awkward, no_documents, some_documents):
    model = language.train(language.learnable(some_documents[0]))
    rows = language.identify(awkward, model).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        lettered = any(c.isalpha() for c in dict(AWKWARD)[r["doc_id"]] or "")
        assert (r["lang_pred"] == "und") == (not lettered)
    assert language.identify(no_documents, model).collect() == []
    nothing = language.train(language.learnable(no_documents))
    assert {r["lang_pred"] for r in language.identify(awkward, nothing).collect()} == {"und"}


def test_back_off_uses_shorter_grams(some_documents):
    scorer = language.Scorer(language.train(language.learnable(some_documents[0])))
    grams, logs = scorer.model.grams, scorer.model.gram_log
    inner = next(g for g in grams[4] if g.isalpha())
    assert np.allclose(scorer.back_off("ωω" + inner + "ωω"), logs[4][grams[4][inner]])
    letter = next(g for g in grams[1] if g.isalpha())
    assert np.allclose(scorer.back_off("ω" + letter + "ω"), logs[1][grams[1][letter]])
    assert (scorer.back_off("🙂") == 0).all()


def test_op8_by_hand(spark):
    urls = [(1, None), (2, "no scheme/net/"), (3, "HTTP://A.Example.NET/en/x?net"), (4, "http://b.net/"), (5, "x://example.com/de/1#a"), (6, "http://notexample.com/de/"), (7, "http://net"), (8, "http://m.casino-win.example.com/a"), (9, "http://casinos.org/"), (10, "http://a.org/fr/free?win"), (11, "http://free.com/win"), (12, "http://freewin.com/win"), (13, "http://a.com/?u=://b.net/"), (8, "http://m.casino-win.example.com/a")]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in urls], "page_id long, url string, host string, rule string")
    found = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages).collect())
    assert found == [
        (1, "", "", None, "allow"),
        (2, "", "", None, "allow"),
        (3, "a.example.net", "/en/x", "example.net/en/", "allow"),
        (4, "b.net", "/", "net/", "block"),
        (5, "example.com", "/de/1", "example.com/de/", "block"),
        (6, "notexample.com", "/de/", None, "allow"),
        (7, "net", "", None, "allow"),
        (8, "m.casino-win.example.com", "/a", None, "block"),
        (8, "m.casino-win.example.com", "/a", None, "block"),
        (9, "casinos.org", "/", None, "allow"),
        (10, "a.org", "/fr/free", "org/fr/", "allow"),
        (11, "free.com", "/win", None, "block"),
        (12, "freewin.com", "/win", None, "allow"),
        (13, "a.com", "/", None, "allow"),
    ]
    assert url_filter.judge_urls(pages.limit(0)).collect() == []
    more = [(1, "http://x.org/a%20casino%20b"), (2, "http://x.org/%63asino"), (3, "http://x.org/casino7"), (4, "http://7casino.org/"), (5, "http://x.org/é-casino-é"), (6, "http://x.org/free+free"), (7, "http://x.org/Gratis_GEWINNSPIEL")]
    judged = url_filter.judge_urls(spark.createDataFrame(more, "page_id long, url string")).orderBy("page_id").collect()
    assert [r["verdict"] for r in judged] == ["block", "allow", "allow", "allow", "block", "allow", "block"]
    terms = spark.createDataFrame([("Tulip", 1.0), ("rose", 0.5), ("rose", 0.2), ("lily", 0.5), ("fern", 0.0), (None, 1.0)], "term string, weight double")
    strict, soft = url_filter.vocabulary(terms)
    assert (strict, soft) == (["tulip"], ["lily", "rose"])
    garden = spark.createDataFrame([(1, "a://b/tulip"), (2, "a://b/rose"), (3, "a://b/rose-lily"), (4, "a://b/casino")], "page_id long, url string")
    assert [r["verdict"] for r in url_filter.judge_urls(garden, strict=strict, soft=soft).orderBy("page_id").collect()] == ["block", "allow", "block", "allow"]


def crowd_texts(size=1500, pairs=40):
    """A passage fills 80 % of every text, so all are at 0.67 of each other; of some pairs the rest agrees too, at 0.76."""
    rng = np.random.default_rng(23)
    passage, texts = [f"p{i}" for i in range(164)], {}
    for d in range(size):
        texts[d] = " ".join(passage + [f"d{d}x{i}" for i in range(40)])
    for k in range(pairs):
        own = texts[k].split()
        texts[size + k] = " ".join(own[:-27] + [f"e{k}x{i}" for i in range(27)])
    order = rng.permutation(len(texts))
    return {int(i): texts[d] for d, i in enumerate(order)}


def test_op10_links_in_a_crowd_of_large_background(spark):
    """Pairs just over the limit amid a crowd just under it, which no minwise token tells apart."""
    texts = crowd_texts()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = near_dup.near_duplicates(docs).collect()
    assert sum(not r["kept"] for r in rows) == 40
    same_as_plain(rows, texts)


def test_op3_links_each_length_and_finishes_what_the_graph_misses(spark, monkeypatch):
    """A search that finds nothing for small groups fails the audit each time, and all are compared with all."""
    rng = np.random.default_rng(31)
    base = rng.normal(size=16)
    near = [rng.normal(size=16) for _ in range(100)]
    rows = [base + 0.02 * rng.normal(size=16) for _ in range(300)] + near + [r + 0.02 * rng.normal(size=16) for r in near]
    rows = [(i, np.float32(r).tolist()) for i, r in enumerate(rows)]
    search, tried = graph.search_shards, []

    def blind(*args):
        tried.append(args)
        return search(*args).filter("vec_id < 300")

    monkeypatch.setattr(graph, "search_shards", blind)
    short = [(1000, [1.0, 0.0]), (1001, [2.0, 0.01]), (1002, [0.0, 1.0])]
    found, true = as_dict(graph.link_vectors(vectors(spark, rows + short))), plain_links(rows)
    assert len(tried) >= 4 and {i: found[i] for i in true} == true
    assert [found[i] for i in (1000, 1001, 1002)] == [(1, 1000, True), (1, 1000, False), (0, 1002, True)]


def test_op9_keeps_small_languages(spark):
    """A language of a few rows stays, with its words and its unsegmented runs, beside one that fills every cap."""
    rng = np.random.default_rng(3)
    large = [(i, " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(40)), "aa") for i in range(400)]
    small = [(1000 + i, " ".join("".join(rng.choice(list("бвгджз"), 6)) for _ in range(10)), "bb") for i in range(4)]
    runs = [(2000 + i, "".join(rng.choice(list("你好世界天地"), 200)), "cc") for i in range(4)]
    labelled = spark.createDataFrame(large + small + runs, "doc_id long, text string, lang string")
    model = language.train(labelled, max_docs=60, max_words=100, max_grams=100)
    assert model.languages == ("aa", "bb", "cc") and set(small[0][1].split()) <= set(model.words)
    scorer = language.Scorer(model)
    assert [scorer.predict(t)[0] for t in (large[0][1], "бвг джз", "好世天你" * 30)] == ["aa", "bb", "cc"]


def test_op10_deals_crowds_into_blocks(spark, monkeypatch):
    """Blocks of a crowd meet two by two, so they change no result; nor do copies of rows and long sets among short ones."""
    monkeypatch.setattr(near_dup, "CROWD_BLOCK", 40)
    texts = crowd_texts(300, 20)
    texts |= {1000 + d: " ".join(t.split() + [f"z{i}" for i in range(60 * (d % 9))]) for d, t in list(texts.items())[:60]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    same_as_plain(near_dup.near_duplicates(docs).collect(), texts)


def test_parity_bitmaps_bound_the_difference():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 400, n)) for n in (0, 3, 90, 120, 300, 310, 1500)]
    texts += [t + " tail of it" for t in texts]
    sets = shingles.shingle_sets(shingles.plain(pa.array(texts)))
    maps = [np.unpackbits(np.frombuffer(m, dtype=np.uint8), bitorder="little") for m in near_dup.parities(sets).to_pylist()]
    own = [set(sets.values[a:b].tolist()) for a, b in zip(sets.bounds, sets.bounds[1:], strict=False)]
    assert [len(m) for m in maps] == near_dup.widths(sets.sizes()).tolist()
    for x, a in zip(own, maps, strict=True):
        for y, b in zip(own, maps, strict=True):
            width = min(len(a), len(b))
            folded = [m.reshape(-1, width).sum(0) % 2 for m in (a, b)]
            assert int((folded[0] != folded[1]).sum()) <= len(x ^ y)
