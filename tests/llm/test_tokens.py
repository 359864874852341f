"""Encoding against the tokenizers library, packing, and the plane files' round trip."""

import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm import chunks, packing, pieces, planes
from quire.llm.chunks import op5_chunks
from quire.llm.packing import op1_packing
from quire.llm.planes import op7_planes

from .conftest import AWKWARD

BYTE, WORD = (public_tokenizers.path(f"{x}.json") for x in ("byte_bpe_50k", "word_bpe_49k"))
LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


def library_ids(path, text):
    return LIBRARY[path].encode(text, add_special_tokens=False).ids


TEXTS = st.text(alphabet=st.one_of(st.characters(max_codepoint=255), st.sampled_from("   \n\t'sdtmrvle\xa0\x85<|>")), max_size=60)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_equal_the_library(path):
    encode = pieces.encoder(path)
    assert encode.pattern is not None

    @settings(max_examples=400, deadline=None)
    @given(TEXTS)
    def same(text):
        assert encode.ids(text).tolist() == library_ids(path, text)

    same()
    for _, text in AWKWARD:
        assert encode.ids(text or "").tolist() == library_ids(path, text or "")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["alpha beta ", "  ", "\n\n", "don't ", "x" * 40, "你好 ", " <|endoftext|>", "q, r. s! "]), max_size=200))
def test_chunked_encoding_equals_the_library(parts):
    text = "".join(parts)
    ids = chunks.chunk_encoder(BYTE).ids(text)
    assert ids.tolist() == library_ids(BYTE, text)
    assert chunks.decoder(BYTE).decode(ids) == LIBRARY[BYTE].decode(ids.tolist(), skip_special_tokens=False)


def test_chunks_are_shared_and_complete():
    shared = " ".join(f"word{i * i}" for i in range(2000))
    one, two = chunks.cut("intro of one kind. " + shared), chunks.cut("quite another, longer start of a document! " * 9 + shared)
    assert "".join(one) == "intro of one kind. " + shared
    assert len(set(one) & set(two)) >= len(one) - 3
    encode = chunks.ChunkEncoder(BYTE)
    encode.ids("".join(one))
    encoded = encode.encoded
    encode.ids("".join(two))
    assert encode.reused >= len(one) - 3 and encode.encoded < 2 * encoded


def test_decode_of_any_ids_equals_the_library():
    rng = np.random.default_rng(3)
    for _ in range(50):
        ids = rng.integers(0, 50257, 20)
        assert chunks.decoder(BYTE).decode(ids) == LIBRARY[BYTE].decode(ids.tolist(), skip_special_tokens=False)


def test_op5_equals_the_library(spark, sf_dir, some_documents):
    rows = op5_chunks(spark, sf_dir).collect()
    assert len(rows) == len(some_documents[1])
    for r in rows:
        text = some_documents[1][r["doc_id"]] or ""
        ids = library_ids(BYTE, text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == sha256(LIBRARY[BYTE].decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op5_awkward_and_empty(awkward, no_documents):
    texts = dict(AWKWARD)
    rows = chunks.encode_documents(awkward, BYTE).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        assert np.frombuffer(bytes(r["ids"]), dtype="<u4").tolist() == library_ids(BYTE, texts[r["doc_id"]] or "")
        assert r["decoded"] == (texts[r["doc_id"]] or "")
    assert chunks.encode_documents(no_documents, BYTE).collect() == []


def check_packing(rows, ids_of, counts):
    """Every id in exactly one piece, sequences gapless and of at most 1024, little padding."""
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    padding = total = 0
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
        total += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding <= 0.01 * total
    for doc, copies in counts.items():
        ids = ids_of(doc)
        raw = np.array(ids, dtype="<u4")
        assert sum(p[1] for p in by_doc[doc]) == copies * len(ids)
        covered = np.zeros(len(ids), dtype=int)
        for start, length, crc, tokens in by_doc[doc]:
            assert tokens == len(ids) and crc == zlib.crc32(raw[start : start + length].tobytes())
            covered[start : start + length] += 1
        assert (covered == copies).all()


def test_op1_packs_every_id_once(spark, sf_dir, some_documents):
    texts = some_documents[1]
    rows = op1_packing(spark, sf_dir).collect()
    check_packing(rows, lambda d: library_ids(BYTE, texts[d] or "") + [0], dict.fromkeys(texts, 1))


def test_op1_awkward_and_empty(awkward, no_documents):
    from pyspark.sql import functions as F

    counts = {d: sum(x == d for x, _ in AWKWARD) for d, _ in AWKWARD}
    texts = dict(AWKWARD)
    packed = packing.pack_documents(awkward, BYTE).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_packing(packed, lambda d: library_ids(BYTE, texts[d] or "") + [0], counts)
    assert packing.pack_documents(no_documents, BYTE).collect() == []


def test_packer_fills_tiers():
    packer = packing.Packer((128, 256, 512, 1024), 4096, 0, buffer=50)
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 3000, 500)
    for i, n in enumerate(sizes):
        packer.add(i, np.arange(n))
    packer.finish()
    lengths, tier_of, groups = defaultdict(int), {}, defaultdict(int)
    for _, _, length, _, sequence, _, tier, group, _ in packer.rows_so_far():
        lengths[sequence] += length
        tier_of[sequence] = tier, group
    assert sum(lengths.values()) == sizes.sum()
    assert sum(n not in (128, 256, 512, 1024) for n in lengths.values()) <= 8
    for s, n in lengths.items():
        groups[tier_of[s]] += n
    full = [n for (tier, _), n in groups.items() if tier == 1024]
    assert sum(n == 4096 for n in full) >= len(full) - 1


@pytest.mark.parametrize("unit", [1, 8])
@pytest.mark.parametrize("size", [0, 1, 7, 65_536, 100_001])
def test_planes_round_trip(unit, size):
    rng = np.random.default_rng(size)
    ids = rng.integers(0, 49408, size).astype("<u4")
    ids[::97] = 2**32 - 1
    found = planes.read_segment(planes.write_segment([5, -1, 2**40], [0, size, 0], ids, unit))
    assert found.ids.tolist() == ids.tolist() and found.doc_ids.tolist() == [5, -1, 2**40] and found.lengths.tolist() == [0, size, 0]
    with pytest.raises(ValueError):
        planes.read_segment(b"????" + bytes(60))


def plain_store(texts):
    out, start = {}, 0
    for d in sorted(texts):
        ids = library_ids(WORD, texts[d] or "") + [2]
        out[d] = start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
    return out


def test_op7_equals_plain_order(spark, sf_dir, some_documents):
    rows = op7_planes(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows} == plain_store(some_documents[1])


def test_op7_awkward_and_empty(awkward, no_documents):
    rows = planes.store_ids(awkward, WORD).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted(d for d, _ in AWKWARD)
    at = 0
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), dtype="<u4").tolist()
        assert r["start"] == at and ids == library_ids(WORD, dict(AWKWARD)[r["doc_id"]] or "") + [2]
        at += r["n_tokens"]
    assert planes.store_ids(no_documents, WORD).collect() == []
