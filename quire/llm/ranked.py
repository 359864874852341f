"""Ranked lexical search: documents in strata of one length normaliser, whose bounds order the visits."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.tables import table
from quire.shared import discard, materialize

#: The contract's terms, on the UTF-8 bytes of a text: every byte of a character from U+0080 on is 80 or above.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Queries are taken in blocks of so many bytes of text, on the average; a block's terms and weights are broadcast.
BLOCK_BYTES = 1 << 20
#: Documents of an index partition, on the average.
SHARD_ROWS = 50_000
TERMS_AT_ONCE, DOCS_AT_ONCE = 4096, 1024
COUNTED = "doc_id long, serial long, n long, terms array<int>, tfs array<long>"


def terms_of(text: str | None) -> list[bytes]:
    return TERM.findall(text.encode().lower()) if text else []


@dataclass(frozen=True)
class Queries:
    """Entries (query, term number, occurrences) of all items."""

    size: int
    owners: np.ndarray
    terms: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> tuple[Queries, dict[bytes, int]]:
        """The entries, and the numbers of the terms."""
        vocabulary: dict[bytes, int] = {}
        rows = [(q, vocabulary.setdefault(t, len(vocabulary)), n) for q, text in enumerate(texts) for t, n in Counter(terms_of(text)).items()]
        return cls(len(texts), *np.array(rows, np.int64).reshape(-1, 3).T), vocabulary


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, serial (its place in the task), n and the numbers and occurrences of the queries' terms, of every
    document with a term. One pass, without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, serial = sent.value, 0
        for part in batches:
            rows = []
            for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                found = terms_of(text)
                serial += 1
                if found:
                    tfs = Counter(k for t in found if (k := known.get(t)) is not None)
                    rows.append((doc_id, serial, len(found), list(tfs), list(tfs.values())))
            types = pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["doc_id", "serial", "n", "terms", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(count, COUNTED)


@dataclass(frozen=True)
class Best:
    """The ``k`` best documents of each query so far: rows of (-score, no doc_id, doc_id), sorted."""

    k: int
    rows: list[list[tuple[int, bool, int]]]

    def least(self) -> np.ndarray:
        """The score that a document must reach to matter for each query."""
        return np.array([-r[-1][0] if len(r) == self.k else 1 for r in self.rows], np.int64)

    def offer(self, query: int, scores: np.ndarray, missing: np.ndarray, ids: np.ndarray) -> None:
        """Take in documents that reach the least score."""
        first = np.lexsort([ids, missing, -scores])[: self.k]
        some = zip((-scores[first]).tolist(), missing[first].tolist(), ids[first].tolist(), strict=True)
        self.rows[query] = sorted([*self.rows[query], *some])[: self.k]


@dataclass(frozen=True)
class Strata:
    """Postings of some documents, grouped by stratum and in it by term and tf.

    ``lists`` has a row for each (stratum, term, tf): its impact, weight times tf part, is computed once.
    """

    norms: np.ndarray  # m of each stratum
    doc_ids: np.ndarray
    missing: np.ndarray
    doc_bounds: np.ndarray  # documents of stratum s: doc_bounds[s] to doc_bounds[s + 1]
    postings: np.ndarray  # documents, list by list
    list_bounds: np.ndarray
    list_terms: np.ndarray
    list_impacts: np.ndarray
    stratum_lists: np.ndarray  # lists of stratum s: stratum_lists[s] to stratum_lists[s + 1]

    @classmethod
    def build(cls, m: np.ndarray, doc_ids: np.ndarray, missing: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray) -> Strata:
        order = np.argsort(m, kind="stable")
        place = np.empty(len(m), np.int64)
        place[order] = np.arange(len(m))
        norms, first = np.unique(m[order], return_index=True)
        bounds = np.append(first, len(m))
        doc = place[np.repeat(np.arange(len(m)), sizes)]
        stratum = np.searchsorted(bounds, doc, "right") - 1
        by = np.lexsort([doc, tfs, terms, stratum])
        doc, stratum, terms, tfs = doc[by], stratum[by], terms[by].astype(np.int64), tfs[by]
        new = np.ones(len(doc), bool)
        new[1:] = (stratum[1:] != stratum[:-1]) | (terms[1:] != terms[:-1]) | (tfs[1:] != tfs[:-1])
        starts = np.flatnonzero(new)
        impacts = weights[terms[starts]] * (1_000_000_000 * tfs[starts] // (1000 * tfs[starts] + 8 * norms[stratum[starts]]))
        lists = np.searchsorted(stratum[starts], np.arange(len(norms) + 1))
        return cls(norms, doc_ids[order], missing[order], bounds, doc, np.append(starts, len(doc)), terms[starts], impacts, lists)

    def bounds(self, queries: Queries, n_terms: int) -> np.ndarray:
        """[stratum, query]: no document of the stratum scores more. A term's part is its greatest impact there."""
        out = np.zeros((len(self.norms), queries.size), np.int64)
        for s in range(len(self.norms)):
            top = np.zeros(n_terms, np.int64)
            some = slice(self.stratum_lists[s], self.stratum_lists[s + 1])
            np.maximum.at(top, self.list_terms[some], self.list_impacts[some])
            np.add.at(out[s], queries.owners, top[queries.terms] * queries.times)
        return out

    def scores(self, s: int, low: int, high: int, queries: Queries, live: np.ndarray) -> np.ndarray:
        """[document, live query]: whole scores of documents low to high of stratum s."""
        out = np.zeros((high - low, len(live)), np.int64)
        column_of = np.full(queries.size, -1)
        column_of[live] = np.arange(len(live))
        asked = column_of[queries.owners] >= 0
        owners, wanted, n = column_of[queries.owners[asked]], queries.terms[asked], queries.times[asked]
        begin, end = self.stratum_lists[s], self.stratum_lists[s + 1]
        terms = np.unique(self.list_terms[begin:end])
        for some in (terms[b : b + TERMS_AT_ONCE] for b in range(0, len(terms), TERMS_AT_ONCE)):
            times = np.zeros((len(some), len(live)), np.int64)
            at = np.minimum(np.searchsorted(some, wanted), len(some) - 1)
            hit = some[at] == wanted
            times[at[hit], owners[hit]] = n[hit]
            one, last = np.searchsorted(self.list_terms[begin:end], [some[0], some[-1] + 1]) + begin
            own = slice(self.list_bounds[one], self.list_bounds[last])
            column = np.repeat(np.searchsorted(some, self.list_terms[one:last]), np.diff(self.list_bounds[one : last + 1]))
            value = np.repeat(self.list_impacts[one:last], np.diff(self.list_bounds[one : last + 1]))
            row = self.postings[own] - self.doc_bounds[s] - low
            inside = (row >= 0) & (row < high - low)
            dense = np.zeros((high - low, len(some)), np.int64)
            dense[row[inside], column[inside]] = value[inside]
            out += exact_product(dense, times)
        return out

    def search(self, queries: Queries, n_terms: int, best: Best) -> None:
        """Strata by their greatest bound; of each, the queries whose bound reaches what their k-th document has."""
        bounds = self.bounds(queries, n_terms)
        for s in np.argsort(-bounds.max(1), kind="stable") if queries.size else []:
            for low in range(0, self.doc_bounds[s + 1] - self.doc_bounds[s], DOCS_AT_ONCE):
                least = best.least()
                live = np.flatnonzero(bounds[s] >= least)
                if not len(live):
                    break
                high = min(low + DOCS_AT_ONCE, self.doc_bounds[s + 1] - self.doc_bounds[s])
                scores = self.scores(s, low, high, queries, live)
                good = scores >= least[live]
                for k in np.flatnonzero(good.any(0)):
                    at = np.flatnonzero(good[:, k])
                    whole = self.doc_bounds[s] + low + at
                    best.offer(live[k], scores[at, k], self.missing[whole], self.doc_ids[whole])


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of non-negative integers: by doubles while they hold every sum exactly, else by integers."""
    if len(a) and a.max(initial=0) * float(b.sum(0).max(initial=0)) < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def search_block(docs: DataFrame, texts: list[str], k: int) -> DataFrame:
    """query (place in ``texts``), doc_id, score: the ``k`` best documents of each index partition, or more."""
    spark = docs.sparkSession
    queries, vocabulary = Queries.of(texts)
    rows = materialize(counted(docs, vocabulary), "counted")
    facts = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    df = [0] * len(vocabulary)
    # One number for each term of the block's queries, which BLOCK_BYTES bounds.
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    weights = np.array([floor(1000 * log((2 * facts["n"] + 2) / (2 * d + 1))) for d in df], np.int64)
    sent = spark.sparkContext.broadcast((queries, weights))
    shards = max(spark.sparkContext.defaultParallelism, -(-facts["n"] // SHARD_ROWS))
    m = F.expr(f"25 + (75 * n * {facts['n']}L) div {max(1, facts['l'])}L")
    index = rows.withColumn("m", m).repartitionByRange(shards, "m", "doc_id", "serial").sortWithinPartitions("m")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = sent.value
        best = Best(k, [[] for _ in range(queries.size)])
        for part in batches:
            doc_ids, tfs, terms = part["doc_id"], part["tfs"], part["terms"]
            sizes = np.diff(terms.offsets.to_numpy())
            ids = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
            missing = doc_ids.is_null().to_numpy(zero_copy_only=False)
            strata = Strata.build(part["m"].to_numpy(), ids, missing, sizes, terms.flatten().to_numpy(), tfs.flatten().to_numpy(), weights)
            strata.search(queries, len(weights), best)
        found = [(q, None if none else d, -score) for q, own in enumerate(best.rows) for score, none, d in own]
        yield pa.record_batch([pa.array([f[c] for f in found], pa.int64()) for c in range(3)], ["query", "doc_id", "score"])

    out = materialize(index.select("doc_id", "m", "terms", "tfs").mapInArrow(search, "query long, doc_id long, score long"), "ranked")
    discard(rows)
    return out


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best rows of ``docs(doc_id, text, ...)`` with a score above 0 for each
    different row of ``items(item_id, text, ...)``, equal scores by doc_id, those without one last. Exact.

    The items come in blocks of about BLOCK_BYTES of text; for each the documents are read once, and of each its
    length and the block's terms written to the shared folder. These rows are the index: dealt in ranges of the
    normaliser m, so that a partition holds few strata, a large stratum being cut by doc_id. A partition is searched
    batch by batch, in bounded memory, and gives k documents a query at most.

    Texts without a term (null, empty, blank) are no documents and find nothing. Copies are documents each for
    itself. Equal rows of ``items`` are one; different texts of one item_id are ranked each for itself, under that
    id. Further columns are ignored. Without documents or items the result is empty.
    """
    spark = docs.sparkSession
    wanted = items.select("item_id", "text").distinct()
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    found = []
    for b in range(n_blocks):
        rows = sorted(wanted.filter(block == b).collect(), key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"] or ""))
        hits = search_block(docs, [r["text"] for r in rows], k)
        names = spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(rows)], "query long, item_id long")
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        top = hits.withColumn("rank", place).filter(F.col("rank") <= k)
        found.append(top.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionAll, found)


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    found = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return rf"""WITH d AS (SELECT doc_id, {found} AS ts FROM documents),
e AS (SELECT doc_id, len(ts) AS n, ts FROM d WHERE len(ts) > 0),
s AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM e),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({found}) AS t FROM benchmark) GROUP BY 1, 2),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, n, unnest(ts) AS t FROM e) WHERE t IN (SELECT t FROM q) GROUP BY 1, 2, 3),
w AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY t, nn),
x AS (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))) AS part FROM p JOIN w USING (t), s),
r AS (SELECT item_id, doc_id, CAST(sum(part * times) AS BIGINT) AS score FROM x JOIN q USING (t) GROUP BY 1, 2),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10"""
