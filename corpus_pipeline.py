"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; ``docs`` has the columns
of ``documents``. The last stage returns the pieces of the sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import language, near_dup, packing, secrets
from quire.llm.spans import joined
from quire.llm.tables import lean, small_batches, table
from quire.shared import discard, materialize

LEAST_SCORE = 0.3
MASK = "[secret]"
ROW = "quire_row"
#: No SQL gives the rows of a trained network or of a tokenizer; the stages are tested against plain versions.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose best language is no likelier than LEAST_SCORE, go.

    The model learns from the labelled documents of the table itself. Each row is judged by its own text, so
    repeated doc_ids and null ones need no rule. Null texts go; empty tables stay empty.
    """
    small_batches(spark)
    sent = spark.sparkContext.broadcast(language.train(language.learnable(docs)))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = language.Scorer(sent.value)
        for part in batches:
            found = map(scorer.predict, part["text"].to_pylist())
            yield part.filter(pa.array([lang != language.UNDETERMINED and score >= LEAST_SCORE for lang, score in found], pa.bool_()))

    return docs.mapInArrow(lean(keep), docs.schema)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, that with the smallest doc_id (null ones last).

    Rows are told apart by a key of the stage, so rows of one doc_id, or without one, are grouped by their texts
    like all others: of copies one stays, and different texts of one doc_id stay each.
    """
    small_batches(spark)
    keyed = materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "keyed")
    found = near_dup.near_duplicates(keyed.select(F.col(ROW).alias("doc_id"), "text")).select(F.col("doc_id").alias(ROW), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", ROW)
    kept = keyed.select(ROW, "doc_id").join(found, ROW).groupBy("component_id").agg(F.min(order)[ROW].alias(ROW))
    return keyed.join(kept.select(ROW), ROW, "left_semi").select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by MASK, and n_chars follows; documents without one stay as they are.

    Each row is masked by the spans of its own text, whatever its doc_id.
    """
    small_batches(spark)
    sent = spark.sparkContext.broadcast(secrets.train_network(*secrets.labelled_candidates(docs)))

    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = secrets.network_finder(sent.value)
        for part in batches:
            texts = part["text"].to_pylist()
            base = [secrets.base_spans(t or "") for t in texts]
            more = find([t or "" for t in texts], base)
            spans = [joined(x + y) for x, y in zip(base, more, strict=True)]
            masked = [mask(t, s) for t, s in zip(texts, spans, strict=True)]
            sizes = [len(t) if s else n for t, s, n in zip(masked, spans, part["n_chars"].to_pylist(), strict=True)]
            new = {"text": masked, "n_chars": sizes}
            yield pa.record_batch([pa.array(new[f.name], f.type) if f.name in new else part[f.name] for f in part.schema], part.schema)

    return docs.mapInArrow(lean(hide), docs.schema)


def mask(text: str | None, spans: str) -> str | None:
    """``text`` with each stretch that the spans cover, joined where they overlap, replaced by MASK."""
    if text is None or not spans:
        return text
    out, done = [], 0
    for start, end in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",")):
        if end <= done:
            continue
        if start >= done:
            out += text[done:start], MASK
        done = end
    return "".join([*out, text[done:]])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences, ids included."""
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path(packing.VOCABULARY))


STAGES = [
    ("language_id", identify_language),
    ("near_dup", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage kept is removed once the next one has written its own."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
