"""Language identification by words first, then by ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.tables import SAMPLE_SPACE, held_out, lean, table
from quire.shared import materialize

WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
CACHED_WORDS = 100_000


@dataclass(frozen=True)
class LanguageModel:
    """Log frequencies by language; ``grams[n]`` backs up words that ``words`` doesn't have."""

    languages: tuple[str, ...]
    words: dict[str, int]
    word_log: np.ndarray
    grams: dict[int, dict[str, int]]
    gram_log: dict[int, np.ndarray]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def has_letter(words: list[str]) -> bool:
    return any(w[0].isalpha() or any(map(str.isalpha, w)) for w in words)


def log_table(counts: dict[str, np.ndarray], n_languages: int) -> tuple[dict[str, int], np.ndarray]:
    """Add-half smoothed log frequency of every key in each language."""
    table = np.array(list(counts.values()), dtype=np.float64).reshape(len(counts), n_languages)
    logs = np.log(table + 0.5) - np.log(table.sum(0) + 0.5 * max(1, len(table)))
    return {k: i for i, k in enumerate(counts)}, logs.astype(np.float32)


def grams_of(word: str, n: int) -> list[str]:
    padded = f"^{word}$" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def quota(counts: list[int], total: int) -> int:
    """The largest number of which each count may use its own at most, so that all together use ``total`` at most."""
    left, owners = total, len(counts)
    for n in sorted(counts):
        if n * owners > left:
            return max(1, left // owners)
        left, owners = left - n, owners - 1
    return max(counts, default=0)


def train(
    labelled: DataFrame,
    max_docs: int = 8_000,
    max_words: int = 100_000,
    max_grams: int = 50_000,
    max_languages: int = 256,
    longest: int = 4,
    longest_word: int = 64,
) -> LanguageModel:
    """Fit on ``labelled(doc_id, text, lang)``: at most about ``max_docs`` rows, of the ``max_languages`` most
    frequent languages, and about ``max_words`` words and ``max_grams`` n-grams of each size.

    Every language has the same quota of each; what a language doesn't use goes to the others (``quota``).
    n-grams are counted over all words of the sample, whatever the cap on words; words of more than ``longest_word``
    characters, which are runs of unsegmented scripts, are told by their n-grams alone. So the model, and what goes
    to the driver, has a fixed size whatever the table's, and a language's place in it doesn't depend on others'.
    """
    rows = labelled.select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()}
    each = quota(list(sizes.values()), max_docs)
    shares = [(lang, SAMPLE_SPACE if n <= each else max(1, each * SAMPLE_SPACE // n)) for lang, n in sizes.items()]
    shares = labelled.sparkSession.createDataFrame(shares, "lang string, share long")
    sample = rows.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(SAMPLE_SPACE)) < F.col("share"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            seen: dict[str, Counter] = defaultdict(Counter)
            for text, lang in zip(part["text"], part["lang"], strict=True):
                seen[lang].update(words_of(text))
            found = [(lang, 0, w, n) for lang, c in seen.items() for w, n in c.items() if len(w) <= longest_word]
            for lang, c in seen.items():
                for size in range(1, longest + 1):
                    grams: Counter = Counter()
                    for w, n in c.items():
                        for g in grams_of(w, size):
                            grams[g] += n
                    found += [(lang, size, g, n) for g, n in grams.items()]
            yield pd.DataFrame(found, columns=["lang", "size", "item", "n"])

    counts = materialize(sample.mapInPandas(lean(count), "lang string, size int, item string, n long").groupBy("size", "item", "lang").agg(F.sum("n").alias("n")), "counts")
    distinct: dict[int, list[int]] = defaultdict(list)
    for r in counts.groupBy("size", "lang").count().collect():
        distinct[r["size"]].append(r["count"])
    caps = [(size, quota(n, max_grams if size else max_words)) for size, n in distinct.items()]
    caps = labelled.sparkSession.createDataFrame(caps, "size int, cap long")
    place = F.row_number().over(Window.partitionBy("size", "lang").orderBy(F.desc("n"), "item"))
    kept = counts.withColumn("place", place).join(F.broadcast(caps), "size").filter("place <= cap").select("size", "item").distinct()
    # All languages' counts of what any language keeps.
    top = counts.join(kept, ["size", "item"], "left_semi").orderBy("size", "item", "lang").toPandas()
    languages = tuple(sorted(set(top["lang"])))
    column = {lang: i for i, lang in enumerate(languages)}
    words: dict[str, np.ndarray] = {}
    grams: dict[int, dict[str, np.ndarray]] = {n: {} for n in range(1, longest + 1)}
    for lang, size, item, n in zip(top["lang"], top["size"], top["item"], top["n"], strict=True):
        into = grams[size] if size else words
        if item not in into:
            into[item] = np.zeros(len(languages))
        into[item][column[lang]] += n
    index, logs = log_table(words, len(languages))
    tables = {n: log_table(kept, len(languages)) for n, kept in grams.items()}
    return LanguageModel(languages, index, logs, {n: t[0] for n, t in tables.items()}, {n: t[1] for n, t in tables.items()})


class Scorer:
    """Scores texts with a model; keeps the backed-off rows of words it has met (at most CACHED_WORDS)."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.unseen: dict[str, np.ndarray] = {}
        self.zero = np.zeros(len(model.languages), dtype=np.float32)

    def back_off(self, word: str) -> np.ndarray:
        """Mean log frequency of the longest n-grams of ``word`` that the model has; zero if it has none."""
        row = self.unseen.get(word)
        if row is None:
            row = self.zero
            for n in sorted(self.model.grams, reverse=True):
                known = self.model.grams[n]
                at = [known[g] for g in grams_of(word, n) if g in known]
                if at:
                    row = self.model.gram_log[n][at].mean(0)
                    break
            if len(self.unseen) < CACHED_WORDS:
                self.unseen[word] = row
        return row

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not self.model.languages or not has_letter(words):
            return UNDETERMINED, 0.0
        known, weights, total, index = [], [], self.zero.astype(np.float64), self.model.words
        for w, n in Counter(words).items():
            at = index.get(w)
            if at is None:
                total = total + n * self.back_off(w)
            else:
                known.append(at)
                weights.append(n)
        if known:
            total = total + np.asarray(weights, dtype=np.float32) @ self.model.word_log[known]
        odds = (total - total.max()) * min(1.0, 50 / len(words))
        share = np.exp(odds) / np.exp(odds).sum()
        best = int(share.argmax())
        return self.model.languages[best], float(share[best])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score of every row of ``docs(doc_id, text, ...)``, from its whole text alone.

    ``und`` with score 0 if the text is null or empty, has no letter, or the model learned from nothing.
    Equal scores go to the first language by name. Repeated rows are judged each; further columns are
    ignored. One pass, no shuffle; the model is broadcast and bounded by the parameters of ``train``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for part in batches:
            langs, scores = zip(*map(scorer.predict, part["text"].to_pylist())) if len(part) else ((), ())
            yield pa.record_batch([part["doc_id"], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(label, "doc_id long, lang_pred string, score double")


def learnable(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(learnable(docs)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
