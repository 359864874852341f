"""Found spans: their digests, and the rows that the two scanners return."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def apart(found: list[Span], others: list[Span]) -> list[Span]:
    """Those of ``found`` that overlap none of ``others``."""
    if not found or not others:
        return found
    ranked = sorted(others, key=lambda o: o.start)
    starts, ends = [o.start for o in ranked], list(accumulate((o.end for o in ranked), max))
    out = []
    for f in found:
        before = bisect_left(starts, f.end)
        if not before or ends[before - 1] <= f.start:
            out.append(f)
    return out


def scan(docs: DataFrame, kinds: tuple[str, ...], base: Callable[[str], list[Span]], add: Callable[[], Callable[[list[str], list[list[Span]]], list[list[Span]]]], order: Callable[[Span], tuple]) -> DataFrame:
    """doc_id, a count by kind, base_sha256, spans and n_spans (all of them) of every row of ``docs``.

    ``base`` finds the spans that always stay, ``add()`` makes, once a task, the model's finder for a batch.
    """
    names = [f"n_{k}" for k in kinds]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = add()
        for part in batches:
            texts = [t or "" for t in part["text"].to_pylist()]
            own = [base(t) for t in texts]
            both = [sorted(x + y, key=order) for x, y in zip(own, more(texts, own), strict=True)]
            counts = [pa.array([sum(s.kind == k for s in x) for x in own], pa.int64()) for k in kinds]
            digests = [sha256(joined(sorted(x, key=order)).encode()).hexdigest() for x in own]
            yield pa.record_batch([part["doc_id"], *counts, pa.array(digests, pa.string()), pa.array(map(joined, both), pa.string()), pa.array(map(len, both), pa.int64())], ["doc_id", *names, "base_sha256", "spans", "n_spans"])

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_sha256 string, spans string, n_spans long"
    return docs.select("doc_id", "text").mapInArrow(find, schema)
