"""What a task may hold of texts, tables and documents (finding of round 3: the pipeline's executor memory)."""

import numpy as np
import pyarrow.parquet as pq

from quire.llm import packing, pieces, tables
from quire.shared import discard, materialize


def test_batches_and_reader_are_bounded(spark):
    for key, given, wanted in ((tables.BATCH_SETTING, "64m", 1 << 20), (tables.READER_SETTING, "4096", 512), (tables.READER_SETTING, "100", 100)):
        before = spark.conf.get(key)
        try:
            spark.conf.set(key, given)
            tables.small_batches(spark)
            assert int(spark.conf.get(key)) == wanted
        finally:
            spark.conf.set(key, before)


def test_row_groups_of_kept_tables_are_bounded(spark):
    """24 MB in one task: in one row group before."""
    kept = materialize(spark.range(0, 3000, 1, 1).selectExpr("id", "repeat(uuid(), 225) AS text", "unhex(replace(concat_ws('', transform(sequence(1, 512), x -> uuid())), '-', '')) AS noise"), "groups")
    try:
        [path] = (f for f in kept.inputFiles())
        found = pq.ParquetFile(path.removeprefix("file://")).metadata
        assert found.num_row_groups > 1 and kept.count() == 3000
    finally:
        discard(kept)


def test_remainders_hold_no_document():
    packer = packing.Packer(packing.TIERS, 8192, 0)
    for i in range(50):
        packer.add(i, np.arange(10_240 + 7, dtype="<u4"))
    assert sum((p[2].base if p[2].base is not None else p[2]).nbytes for p in packer.held.values()) <= 50 * 7 * 4


def test_encoder_keeps_few_pieces_and_the_same_ids():
    path = packing.public_tokenizers.path(packing.VOCABULARY)
    found = pieces.PieceEncoder(path)
    text = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576 % 26)}" for i in range(160_000))
    assert list(found.ids(text)) == found.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(found.pieces) <= 150_000


def test_work_that_encodes_nothing_drops_the_encoders_of_earlier_tasks():
    path = packing.public_tokenizers.path(packing.VOCABULARY)
    pieces.encoder(path)
    assert list(tables.lean(iter, encodes=True)([1, 2])) == [1, 2] and pieces.encoder.cache_info().currsize
    assert list(tables.lean(iter)([1, 2])) == [1, 2] and not pieces.encoder.cache_info().currsize
