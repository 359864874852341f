"""Token ids of whole texts as the tokenizers library gives them, with each word encoded once a worker.

The library's byte-pair model works on one pre-token at a time. Texts of Latin-1 characters are cut into
pre-tokens here, by the vocabulary file's own pattern spelled out for those characters, and each different
pre-token is given to the library's model once. All other texts, texts that hold a special token's string,
and files with another pre-tokenizer go to the library whole.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

LETTER, NUMBER, SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \x85\xa0"
# The two public pre-token patterns, for Latin-1.
BYTE_LEVEL = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
WORD_LEVEL = re.compile(f"'(?:[stmd]|re|ve|ll)|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")
WORD_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MAX_CACHED = 150_000


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level models use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(moved)}


class Pieces(dict):
    """Pre-token -> its ids as little-endian 16-bit bytes; keeps at most MAX_CACHED of them."""

    def __init__(self, model):
        self.model = model
        self.alphabet = {chr(b): c for b, c in byte_alphabet().items()}

    def __missing__(self, piece: str) -> bytes:
        mapped = "".join(self.alphabet[chr(b)] for b in piece.encode())
        ids = np.array([t.id for t in self.model.tokenize(mapped)], dtype="<u2").tobytes()
        if len(self) < MAX_CACHED:
            self[piece] = ids
        return ids


class PieceEncoder:
    """Ids of texts under one tokenizers file, add_special_tokens=False, no truncation or padding."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.special = [t["content"] for t in config["added_tokens"]]
        self.small = self.tokenizer.get_vocab_size() <= 65_536
        pre, normal = config["pre_tokenizer"] or {}, config["normalizer"] or {}
        self.pattern, self.lower = None, False
        if not self.small or config["model"]["type"] != "BPE" or config["model"].get("dropout"):
            pass
        elif pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not normal:
            self.pattern = BYTE_LEVEL
        elif [p["type"] for p in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["pattern"].get("Regex") == WORD_LEVEL_SPLIT and [n["type"] for n in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            self.pattern, self.lower = WORD_LEVEL, True
        self.pieces = Pieces(self.tokenizer.model)

    def packed(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian bytes, 16 bits an id if the vocabulary allows, else 32."""
        if self.pattern is not None and not any(s in text for s in self.special):
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text.lower() if self.lower else text)))
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u2" if self.small else "<u4").tobytes()

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), dtype="<u2" if self.small else "<u4")


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder a worker process and file."""
    return PieceEncoder(path)
