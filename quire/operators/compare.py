"""Line comparison of many document pairs."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import joined
from quire.operators.text import escape_html, logical_lines, split_lines

#: Pairs of lines that a comparison may weigh against each other.
MAX_CELLS = 60_000_000_000


def pair_line_counts(pairs: DataFrame, docs: DataFrame, max_side: int | None = None, max_total: int | None = None) -> DataFrame:
    """pair_id, left_lines, right_lines, total_lines, error_code of ``pairs(pair_id, left_id, right_id)``: a code where
    a side, or both together, have more lines than a limit that is given."""
    counts = logical_lines(docs).groupBy("doc_id").agg(F.count("*").alias("n"))
    left, right = counts.select(F.col("doc_id").alias("left_id"), F.col("n").alias("l")), counts.select(F.col("doc_id").alias("right_id"), F.col("n").alias("r"))
    out = pairs.join(left, "left_id", "left").join(right, "right_id", "left").na.fill(0, ["l", "r"])
    out = out.select("pair_id", F.col("l").alias("left_lines"), F.col("r").alias("right_lines"), (F.col("l") + F.col("r")).alias("total_lines"))
    side = F.lit(max_side is not None) & (F.greatest("left_lines", "right_lines") > (max_side or 0))
    both = F.lit(max_total is not None) & (F.col("total_lines") > (max_total or 0))
    return out.withColumn("error_code", F.when(side, "comparison-line-limit").when(both, "comparison-total-line-limit"))


class SuffixTable:
    """The table of common subsequences' lengths of all suffixes of ``a`` and ``b``, a bit for each pair of places.

    Row i has a bit for each place j of b: set if the suffixes from (i, j) have a longer common subsequence than those
    from (i, j + 1). A row follows from the one below it by one addition over whole rows (Crochemore, Iliopoulos,
    Pinzon and Reid, 2001). One row in about sqrt(len(a)) is kept; the rows between are made again when asked for.
    """

    def __init__(self, a: list[int], b: list[int], cached_bytes: int = 32 << 20) -> None:
        self.a, self.width = a, len(b)
        self.full = (1 << self.width) - 1
        self.places: dict[int, list[int]] = {}
        for j, x in enumerate(b):
            self.places.setdefault(x, []).append(self.width - 1 - j)
        self.masks: dict[int, int] = {}
        self.spare = cached_bytes
        self.every = isqrt(len(a)) + 1
        self.kept = {}
        row = self.full
        for i in range(len(a) - 1, -1, -1):
            if (i + 1) % self.every == 0:
                self.kept[i + 1] = row
            row = self.above(row, a[i])
        self.block: dict[int, bytes] = {}

    def mask(self, x: int) -> int:
        """Bits of the places that hold ``x``."""
        if (found := self.masks.get(x)) is not None:
            return found
        places = self.places[x]
        if len(places) < 8:
            out = 0
            for p in places:
                out |= 1 << p
        else:
            bits = np.zeros(self.width, np.uint8)
            bits[places] = 1
            out = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        if self.spare > self.width // 8:
            self.spare -= self.width // 8 + 64
            self.masks[x] = out
        return out

    def above(self, row: int, x: int) -> int:
        """The row of a suffix that is longer by ``x``; unset bits mark where lengths grow."""
        same = row & self.mask(x)
        return (row + same | row - same) & self.full

    def row(self, i: int) -> bytes:
        """Row i, bit by bit from the end of b; asked for in ascending order."""
        if i not in self.block:
            top = (i // self.every + 1) * self.every
            row, last = (self.kept[top], top) if top in self.kept else (self.full, len(self.a))
            self.block = {}
            for k in range(last - 1, i - 1, -1):
                row = self.above(row, self.a[k])
                self.block[k] = row.to_bytes(self.width // 8 + 1, "little")
        return self.block[i]

    def grows(self, i: int, j: int) -> bool:
        place = self.width - 1 - j
        return not self.row(i)[place >> 3] >> (place & 7) & 1


def matched(a: list[int], b: list[int]) -> Iterator[tuple[int, int]]:
    """Ascending pairs of places of one longest common subsequence: from the start on, equal places match; where they
    differ, the right one is passed over if that shortens nothing, else the left one."""
    table = SuffixTable(a, b)
    i = j = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            yield i, j
            i, j = i + 1, j + 1
        elif table.grows(i, j):
            i += 1
        else:
            j += 1


def shortest_edits(a: list[str], b: list[str], max_cells: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Runs (kind, left, right, n) of a shortest edit script, kind an index of KINDS, in each block of changes what is
    removed before what is added. None if more than ``max_cells`` pairs of lines would have to be compared.

    One rule picks among equally short scripts: lines that agree from the start match; of the rest those that agree
    to the end; of the rest, lines that the other side lacks are set aside, and ``matched`` tells what remains.
    """
    head, most = 0, min(len(a), len(b))
    while head < most and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < most - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    n, m = len(a) - tail, len(b) - tail
    codes = {x: k for k, x in enumerate(set(a[head:n]) & set(b[head:m]))}
    left, right = [k for k in range(head, n) if a[k] in codes], [k for k in range(head, m) if b[k] in codes]
    if max_cells is not None and len(left) * len(right) > max_cells:
        return None
    pairs = matched([codes[a[k]] for k in left], [codes[b[k]] for k in right])
    out, i, j = [], 0, 0
    stretches = [(0, 0, head), *((left[p], right[q], 1) for p, q in pairs), (n, m, tail)]
    for p, q, size in stretches:
        out += [(1, i, -1, p - i)] * (p > i) + [(2, -1, j, q - j)] * (q > j)
        if size and out and out[-1][0] == 0:
            out[-1] = (0, out[-1][1], out[-1][2], out[-1][3] + size)
        elif size:
            out.append((0, p, q, size))
        i, j = p + size, q + size
    return out


KINDS = "unchanged", "removed", "added"


def diff_lines(pairs: DataFrame, docs: DataFrame, max_cells: int | None = MAX_CELLS) -> DataFrame:
    """pair_id, ord, kind, left_line, right_line, text, error_code of ``pairs(pair_id, left_id, right_id)``, null or
    missing documents as empty; the shortest edit script that ``shortest_edits`` defines.

    A pair's lines meet in one row; equal ones never leave the JVM. Of the others one Python call a pair returns the
    runs of the script, which built-in functions expand. A pair of more than ``max_cells`` pairs of lines (about half
    a minute's work) has one row with the code ``comparison-complexity-limit``, and no part of a script.
    """

    return script_rows(pairs, docs, max_cells).select("pair_id", F.inline("rows"))


def script_rows(pairs: DataFrame, docs: DataFrame, max_cells: int | None = MAX_CELLS) -> DataFrame:
    """pair_id, rows: ``diff_lines`` with the rows of a pair in one array, in their order."""

    @F.arrow_udf("array<struct<kind:int,left:int,right:int,n:int>>")
    def edits(left: pa.Array, right: pa.Array) -> pa.Array:
        found = [None if a is None else shortest_edits(a, b, max_cells) for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True)]
        rows = [None if f is None else [dict(zip(("kind", "left", "right", "n"), r, strict=True)) for r in f] for f in found]
        return pa.array(rows, pa.list_(pa.struct([(c, pa.int32()) for c in ("kind", "left", "right", "n")])))

    none = F.array().cast("array<string>")
    lines = docs.select("doc_id", F.when(F.length("text") > 0, split_lines(F.col("text"))).otherwise(none).alias("lines"))
    side = lambda key, name: lines.select(F.col("doc_id").alias(key), F.col("lines").alias(name))
    both = pairs.join(side("left_id", "l"), "left_id", "left").join(side("right_id", "r"), "right_id", "left")
    both = both.select("pair_id", F.coalesce("l", none).alias("l"), F.coalesce("r", none).alias("r"))
    same = F.col("l") == F.col("r")
    run = both.withColumn("runs", edits(F.when(~same, F.col("l")), F.when(~same, F.col("r"))))
    whole = F.array(F.struct(F.lit(0).alias("kind"), F.lit(0).alias("left"), F.lit(0).alias("right"), F.size("l").alias("n")))
    # What comes before each run, then its rows: once a pair, so that no row drags the pair's lines along.
    runs = F.filter(F.when(same, whole).otherwise(F.col("runs")), lambda r: r["n"] > 0)
    before = F.aggregate(runs, F.array(F.lit(0)), lambda sums, r: F.concat(sums, F.array(F.element_at(sums, -1) + r["n"])))
    placed = run.select("pair_id", "l", "r", runs.alias("runs"), before.alias("before"))
    kind = lambda r: F.when(r["kind"] == 0, KINDS[0]).when(r["kind"] == 1, KINDS[1]).otherwise(KINDS[2])
    number = lambda start, k: F.when(start >= 0, (start + k + 1).cast("long"))

    def rows(r: Column, at: Column) -> Column:
        one = lambda k: F.struct(
            (F.get("before", at) + k + 1).cast("long").alias("ord"), kind(r).alias("kind"), number(r["left"], k).alias("left_line"), number(r["right"], k).alias("right_line"),
            F.when(r["left"] >= 0, F.get("l", r["left"] + k)).otherwise(F.get("r", r["right"] + k)).alias("text"), F.lit(None).cast("string").alias("error_code"),
        )
        return F.transform(F.sequence(F.lit(0), r["n"] - 1), one)

    null = lambda t, name: F.lit(None).cast(t).alias(name)
    failed = F.array(F.struct(null("long", "ord"), null("string", "kind"), null("long", "left_line"), null("long", "right_line"), null("string", "text"), F.lit("comparison-complexity-limit").alias("error_code")))
    return placed.select("pair_id", F.when(F.col("runs").isNull(), failed).otherwise(F.flatten(F.transform("runs", rows))).alias("rows"))


def diff_stats(diff: DataFrame) -> DataFrame:
    """pair_id, added, removed, unchanged, changed, changed_blocks, identical; a block is a run of one kind. Of a pair
    that wasn't compared all are null."""
    order = Window.partitionBy("pair_id").orderBy("ord")
    marked = diff.withColumn("starts", (F.col("kind") != "unchanged") & ~F.col("kind").eqNullSafe(F.lag("kind").over(order)))
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in ("added", "removed", "unchanged")]
    out = marked.groupBy("pair_id").agg(*kinds, F.count_if("starts").alias("changed_blocks"), F.count("kind").alias("n"))
    out = out.select("pair_id", *[F.when(F.col("n") > 0, F.col(c)).alias(c) for c in ("added", "removed", "unchanged", "changed_blocks")])
    return out.withColumn("changed", F.col("added") + F.col("removed")).withColumn("identical", F.col("changed_blocks") == 0)


def view_limits(diff: DataFrame, max_characters: int, max_lines: int) -> DataFrame:
    """pair_id, error_code: whether a comparison has more text (lines with their ends) or more rows than a view may
    show; the limit that is passed first counts, and within a block of one kind the text's."""
    order = Window.partitionBy("pair_id").orderBy("ord")
    starts = ~F.col("kind").eqNullSafe(F.lag("kind").over(order))
    rows = diff.withColumn("starts", starts.cast("int")).withColumn("block", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.row_number().over(order))
    blocks = rows.groupBy("pair_id", "block").agg(F.sum(F.length("text") + 1).alias("c"), F.max("n").alias("n"))
    blocks = blocks.withColumn("c", F.sum("c").over(Window.partitionBy("pair_id").orderBy("block")))
    facts = blocks.groupBy("pair_id").agg(F.min(F.when(F.col("c") > max_characters, F.col("block"))).alias("t"), F.min(F.when(F.col("n") > max_lines, F.col("block"))).alias("l"))
    text = F.col("t").isNotNull() & (F.col("l").isNull() | (F.col("t") <= F.col("l")))
    return facts.select("pair_id", F.when(text, "comparison-view-text-limit").when(F.col("l").isNotNull(), "comparison-view-line-limit").alias("error_code"))


def report_row(kind: Column, left: Column, right: Column, text: Column) -> Column:
    marker = F.when(kind == "added", "+").when(kind == "removed", "−").otherwise("")
    number = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(F.lit('<div class="diff-row '), kind, F.lit('"><span class="marker">'), marker, F.lit('</span><span class="line">'), number(left), F.lit('</span><span class="line">'), number(right), F.lit("</span><pre>"), escape_html(text), F.lit("</pre></div>"))


def diff_report_html(diff: DataFrame) -> DataFrame:
    """pair_id, html: the rows of a comparison as escaped markup; null for a pair that wasn't compared."""
    row = report_row(*map(F.col, ("kind", "left_line", "right_line", "text")))
    html = joined(F.collect_list(F.struct("ord", row.alias("s"))), "s", "")
    return diff.groupBy("pair_id").agg(F.when(F.count("kind") > 0, html).alias("html"))


def pair_reports(pairs: DataFrame, docs: DataFrame, max_cells: int | None = MAX_CELLS) -> DataFrame:
    """``diff_report_html`` of ``diff_lines`` of unlike ``pairs``, made where a pair's lines meet: no row of it is shuffled."""
    html = F.array_join(F.transform("rows", lambda r: report_row(r["kind"], r["left_line"], r["right_line"], r["text"])), "")
    compared = F.get("rows", F.lit(0))["error_code"].isNull()
    return script_rows(pairs, docs, max_cells).filter(F.size("rows") > 0).select("pair_id", F.when(compared, html).alias("html"))
