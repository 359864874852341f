"""The pipeline's stages against plain versions of each, on what the stage before kept."""

from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quire.llm import packing
from quire.shared import materialize

from .conftest import AWKWARD
from .test_links import plain_near_dup
from .test_scans import plain_secrets
from .test_tokens import BYTE, check_packing


def staged(spark, docs, sf_dir):
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(materialize(stage(spark, frames[-1], sf_dir), name))
    return frames


def texts_of(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_stages_one_by_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw, known, single, masked, packed = staged(spark, docs, sf_dir)
    assert known.columns == single.columns == masked.columns == docs.columns
    before = texts_of(raw)
    assert texts_of(known) == {d: t for d, t in before.items() if any(c.isalpha() for c in t or "")}
    component = plain_near_dup(texts_of(known))[1]
    assert set(texts_of(single)) == {d for d, c in component.items() if c == d}
    hidden, source = 0, texts_of(single)
    for r in masked.collect():
        text = source[r["doc_id"]]
        found = plain_secrets(text)
        assert r["n_chars"] == len(r["text"]) or r["text"] == text
        if found:
            hidden += 1
            assert corpus_pipeline.MASK in r["text"] and all(text[a:b] not in r["text"] for _, a, b in found)
    assert hidden or not any(plain_secrets(t) for t in source.values())
    ids = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    kept = texts_of(masked)
    check_packing(packed.withColumn("ids_crc32", F.crc32("ids")).collect(), lambda d: ids.encode(kept[d], add_special_tokens=False).ids + [packing.END_ID], dict.fromkeys(kept, 1))


def test_texts_of_no_known_language_go(spark, sf_dir):
    """Words of which the model has no n-gram leave all languages alike, under LEAST_SCORE."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(-1, "ωψω ψωψ ξξξ ωωω", None, "s", 15), (-2, "123 456", "en", "s", 7)], docs.schema)
    kept = corpus_pipeline.identify_language(spark, docs.unionByName(odd), sf_dir)
    assert kept.filter("doc_id < 0").count() == 0 and kept.count() == docs.count()


def test_run_equals_the_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = lambda frame: Counter({r["doc_id"]: r["n"] for r in frame.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()})
    assert ids(corpus_pipeline.run(spark, sf_dir)) == ids(staged(spark, docs, sf_dir)[-1])


def test_mask():
    assert corpus_pipeline.mask("abcdef", "hex:1:3,cnn:2:4") == "a[secret]ef"
    assert corpus_pipeline.mask("abcdef", "hex:0:2,hex:4:6") == "[secret]cd[secret]"
    assert corpus_pipeline.mask(None, "") is None and corpus_pipeline.mask("abc", "") == "abc"


def test_awkward_and_empty_tables(spark, sf_dir, no_documents):
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in AWKWARD]
    frames = staged(spark, spark.createDataFrame(rows, no_documents.schema), sf_dir)
    assert {r["doc_id"] for r in frames[1].collect()} == {i for i, t in AWKWARD if any(c.isalpha() for c in t or "")}
    lengths = {r["doc_id"]: r["n"] for r in frames[-1].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert set(lengths) == {r["doc_id"] for r in frames[3].collect()} and np.min(list(lengths.values())) > 0
    assert BYTE and staged(spark, no_documents, sf_dir)[-1].collect() == []


def test_null_and_repeated_ids(spark, no_documents):
    """Each row is judged, compared and masked by its own text: two texts of one id, copies of one id, rows without one."""
    first, second = "the key is password=abcdef12 and it opens the old door", "some quite different words come first here, then token: zyxwvu98 ends it"
    rows = [(1, first), (1, second), (2, first), (2, first), (None, "rows without an id hold secret=qwerty77 as well, as this one does"), (None, first)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], no_documents.schema)
    single = materialize(corpus_pipeline.drop_near_duplicates(spark, docs, ""), "single")
    assert sorted((str(r["doc_id"]), r["text"]) for r in single.collect()) == sorted([("1", first), ("1", second), ("None", rows[4][1])])
    masked = [r["text"] for r in corpus_pipeline.mask_secrets(spark, docs, "").collect()]
    assert sorted(masked) == sorted(corpus_pipeline.mask(t, ",".join(f"{k}:{a}:{b}" for k, a, b in plain_secrets(t))) for _, t in rows)
    known = corpus_pipeline.identify_language(spark, docs.withColumn("doc_id", F.when(F.col("doc_id") == 1, 1)), "")
    assert known.count() == len(rows)
