"""Ordered pages: selections, splits, merges, numbering.

Pages count from 1 everywhere. Selections are tables (doc_id, pos, page); nothing depends on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import joined, trimmed

MAX_EXPRESSION, MAX_ENTRIES = 10_000, 100_000


def lenient_number(text: Column) -> Column:
    """The number that a text starts with, or null."""
    return F.regexp_extract(text, r"^\s*([+-]?[0-9]{1,9})", 1).try_cast("int")


def lenient_parts(docs: DataFrame, max_characters: int, max_entries: int) -> DataFrame:
    """doc_id, pages, error_code, runs (array of first and last page) of ``docs(doc_id, pages, expr)``: nothing is
    expanded here, so an expression of any size costs its own length."""
    n, raw = F.col("pages"), F.lower(trimmed(F.coalesce("expr", F.lit(""))))

    def run(part: Column) -> Column:
        ends = F.split(part, "-", -1)
        low, high = lenient_number(ends[0]), lenient_number(F.try_element_at(ends, F.lit(2)))
        start = F.least(n, F.greatest(F.lit(1), F.coalesce(F.nullif(low, F.lit(0)), F.lit(1))))
        end = F.greatest(F.lit(1), F.least(n, F.coalesce(F.nullif(high, F.lit(0)), n)))
        one = lenient_number(part)
        return F.when(part.contains("-"), F.struct(start.cast("int").alias("a"), end.cast("int").alias("b"))).when(one.between(1, n), F.struct(one.alias("a"), one.alias("b")))

    parts = F.filter(F.transform(F.split(raw, ",", -1), trimmed), lambda p: p != "")
    every = F.array(F.struct(F.lit(1).alias("a"), n.cast("int").alias("b")))
    runs = F.when(F.length(raw) > max_characters, F.lit(None)).when((raw == "") | (raw == "all"), every).otherwise(F.filter(F.transform(parts, run), lambda r: r.isNotNull()))
    rows = docs.filter(n > 0).select("doc_id", "pages", runs.alias("runs"), ((raw == "") | (raw == "all")).alias("every"))
    entries = F.aggregate("runs", F.lit(0).cast("long"), lambda total, r: total + F.abs(r["b"] - r["a"]) + 1)
    code = F.when(F.col("runs").isNull(), "page-selection-too-long").when(~F.col("every") & (entries > max_entries), "page-selection-too-large")
    return rows.select("doc_id", "pages", code.alias("error_code"), "runs")


def select_pages(docs: DataFrame, keep_duplicates: bool = False, max_characters: int = MAX_EXPRESSION, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """doc_id, pos (from 1), page of ``docs(doc_id, pages, expr)``: ranges may run backwards, ends are clamped,
    what can't be read is passed over; an empty expression or ``all`` is every page. Expressions beyond a limit
    select nothing (``selection_errors`` has their codes)."""
    parts = lenient_parts(docs, max_characters, max_entries).filter("error_code IS NULL")
    chosen = F.flatten(F.transform("runs", lambda r: F.sequence(r["a"], r["b"])))
    chosen = chosen if keep_duplicates else F.array_distinct(chosen)
    return parts.select("doc_id", F.posexplode(chosen).alias("pos", "page")).withColumn("pos", F.col("pos") + 1)


def selection_errors(docs: DataFrame, max_characters: int = MAX_EXPRESSION, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """doc_id, error_code of ``docs(doc_id, pages, expr)`` whose expression is too long, or stands for too many pages."""
    return lenient_parts(docs, max_characters, max_entries).filter("error_code IS NOT NULL").select("doc_id", "error_code")


def numbers(df: DataFrame, last: Column, name: str, block: int = 1 << 16) -> DataFrame:
    """A row of ``df`` for each number from 1 to ``last``, whatever its size: a row becomes blocks, which are dealt out,
    and a block its numbers, so that a task holds the numbers of one block at a time."""
    blocks = df.withColumn("_last", last.cast("long")).filter("_last >= 1").select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("_last") - 1) / block))).alias("_block"))
    blocks = blocks.repartition(df.sparkSession.sparkContext.defaultParallelism, *df.columns, "_block")
    inner = F.sequence(F.col("_block") * block + 1, F.least(F.col("_last"), (F.col("_block") + 1) * block))
    return blocks.select("*", F.explode(inner).alias(name)).drop("_last", "_block")


def strict_parts(docs: DataFrame, max_characters: int, max_entries: int) -> DataFrame:
    """doc_id, pages, error_code, every, chosen (array of pages) of ``docs(doc_id, pages, expr)``.

    The entries are gone through in order, with the pages chosen so far as state; the first that is wrong decides the
    code. A range counts by its ends and is expanded up to one page beyond ``max_entries``, which is too many
    whatever came before: state is bounded by the limit, not by the ranges.
    """
    n, raw = F.col("pages").cast("decimal(38,0)"), F.lower(trimmed(F.coalesce("expr", F.lit(""))))
    whole = lambda x: F.lit(x).cast("decimal(38,0)")
    none = F.array().cast("array<bigint>")

    def entry(part: Column) -> Column:
        low = F.regexp_extract(part, r"^([0-9]+)(?:\s*-\s*([0-9]+))?$", 1)
        high = F.regexp_extract(part, r"^([0-9]+)(?:\s*-\s*([0-9]+))?$", 2)
        a, b = low.try_cast("decimal(38,0)"), F.when(high == "", low).otherwise(high).try_cast("decimal(38,0)")
        bad = (low == "") | a.isNull() | b.isNull() | (F.greatest(a, b) > whole(2**53 - 1))
        start_out = (a < whole(1)) | (a > n)
        stop = F.greatest(F.greatest(whole(1), a - whole(max_entries)), F.least(F.least(n, a + whole(max_entries)), b))
        code = F.when(bad, "invalid-page-selection").when(start_out, "page-out-of-range")
        return F.struct(code.alias("code"), F.when(code.isNull(), a).cast("long").alias("a"), F.when(code.isNull(), stop).cast("long").alias("b"), ((b < whole(1)) | (b > n)).alias("leaves"))

    def step(state: Column, e: Column) -> Column:
        pages = F.array_distinct(F.concat(state["pages"], F.coalesce(F.sequence(e["a"], e["b"]), none)))
        code = F.when(e["code"].isNotNull(), e["code"]).when(F.size(pages) > max_entries, "page-selection-too-large").when(e["leaves"], "page-out-of-range")
        after = F.struct(code.alias("code"), F.when(code.isNull(), pages).otherwise(none).alias("pages"))
        return F.when(state["code"].isNotNull(), state).otherwise(after)

    start = F.struct(F.lit(None).cast("string").alias("code"), none.alias("pages"))
    entries = F.transform(F.split(raw, ",", -1), lambda p: entry(trimmed(p)))
    early = F.when(F.length(raw) > max_characters, "page-selection-too-long").when(raw == "", "missing-page-selection")
    every = raw == "all"
    rows = docs.filter("pages > 0").select("doc_id", "pages", early.alias("early"), every.alias("every"), F.when(early.isNull() & ~every, entries).alias("entries"))
    rows = rows.select("doc_id", "pages", "early", "every", F.aggregate("entries", start, step).alias("found"))
    return rows.select("doc_id", "pages", F.coalesce("early", "found.code").alias("error_code"), "every", F.when(F.coalesce("early", "found.code").isNull(), F.col("found.pages")).alias("chosen"))


def select_pages_strict(docs: DataFrame, max_characters: int = MAX_EXPRESSION, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """doc_id, pos, page, error_code: one row with the code for a document whose expression is wrong, or stands for
    more than ``max_entries`` different pages; ``all`` is every page of a document of any size."""
    parts = strict_parts(docs, max_characters, max_entries)
    every = numbers(parts.filter("every AND error_code IS NULL").select("doc_id", "pages", "error_code"), F.col("pages"), "pos")
    chosen = parts.filter("NOT every OR error_code IS NOT NULL").select("doc_id", "error_code", F.posexplode_outer("chosen").alias("pos", "page"))
    return chosen.select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), "page", "error_code").unionByName(every.select("doc_id", "pos", F.col("pos").alias("page"), "error_code"))


def format_selection(selection: DataFrame) -> DataFrame:
    """doc_id, ranges such as ``1-3,6``, of ``selection(doc_id, page)``."""
    order = Window.partitionBy("doc_id").orderBy("page")
    runs = selection.filter("page >= 1").select("doc_id", "page").distinct().withColumn("island", F.col("page") - F.row_number().over(order)).groupBy("doc_id", "island").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    return runs.groupBy("doc_id").agg(joined(F.collect_list(F.struct("a", text.alias("s"))), "s", ",").alias("ranges"))


def extract_pages(pages: DataFrame, selection: DataFrame, combine: bool = True) -> DataFrame:
    """doc_id, output, output_page, page, text: the selected pages in the selection's order, in one output or one each."""
    found = pages.select("doc_id", "page", "text").join(selection.select("doc_id", "page", "pos"), ["doc_id", "page"])
    output, place = (F.lit(1), F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))) if combine else (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")), F.lit(1))
    return found.select("doc_id", output.alias("output"), place.alias("output_page"), "page", "text")


def remove_pages(pages: DataFrame, selection: DataFrame) -> DataFrame:
    """doc_id, page, output_page, text, error_code: the pages that aren't selected; a document of which none or
    all are selected has one row with a code. The pages are read once and dealt by document once more."""
    hits = selection.select("doc_id", "page", F.lit(1).alias("hit")).distinct()
    doc, order = Window.partitionBy("doc_id"), Window.partitionBy("doc_id").orderBy("page")
    marked = pages.select("doc_id", "page", "text").join(hits, ["doc_id", "page"], "left")
    code = F.when(F.col("k") == 0, "missing-page-selection").when(F.col("k") == F.col("n"), "empty-pdf-result")
    marked = marked.withColumns({"k": F.count("hit").over(doc), "n": F.count(F.lit(1)).over(doc), "nth": F.row_number().over(order)})
    marked = marked.withColumns({"error_code": code, "output_page": F.col("nth") - F.count("hit").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    kept = F.col("error_code").isNull()
    shown = lambda c: F.when(kept, F.col(c)).alias(c)
    return marked.filter((kept & F.col("hit").isNull()) | (~kept & (F.col("nth") == 1))).select("doc_id", shown("page"), shown("output_page"), shown("text"), "error_code")


def organize_pages(docs: DataFrame) -> DataFrame:
    """doc_id, outputs, copied, omitted of the page orders ``docs(doc_id, pages, expr)``, repeats allowed."""
    order = select_pages(docs, keep_duplicates=True).groupBy("doc_id").agg(F.count("*").alias("outputs"), F.countDistinct("page").alias("different"))
    return docs.select("doc_id", "pages").join(order, "doc_id").select("doc_id", "outputs", (F.col("outputs") - F.col("different")).alias("copied"), (F.col("pages") - F.col("different")).alias("omitted"))


def custom_groups(n: Column, argument: str, max_characters: int, max_entries: int) -> tuple[Column, Column]:
    """The code and the groups (first, last, n) of a custom split: ``argument`` is a list of pages to split after.
    The first entry that is wrong decides the code; where an entry is too high depends on the document."""
    raw = argument.strip()
    too_long = len(raw) > max_characters
    entries = [e.strip() for e in raw.split(",")] if raw and not too_long else []
    error: tuple[int, str] | None = None
    seen: set[int] = set()
    rising: list[tuple[int, int]] = []  # entries higher than all before them
    for i, e in enumerate(entries):
        if not (e.isascii() and e.isdigit()):
            error = i, "invalid-split-point"
        elif not 1 <= int(e) < 2**53:
            error = i, "split-point-out-of-range"
        else:
            rising += [(i, int(e))] if not rising or int(e) > rising[-1][1] else []
            seen.add(int(e))
            error = (i, "page-selection-too-large") if len(seen) >= max_entries else None
        if error:
            break
    # A document of n pages fails at the first entry of n or more, unless another error comes earlier.
    high = [(i, v) for i, v in rising if not error or i < error[0] or error[1] == "page-selection-too-large" and i == error[0]]
    beyond = F.lit(max((v for _, v in high), default=0)) >= n
    code = F.when(beyond, "split-point-out-of-range").otherwise(F.lit("page-selection-too-long" if too_long else error[1] if error else None).cast("string"))
    breaks = sorted(seen)
    run = lambda a, b: F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"))
    ends = F.array(*[run(a + 1, b) for a, b in zip([0, *breaks], breaks, strict=False)], F.struct(F.lit((breaks or [0])[-1] + 1).cast("long").alias("a"), n.alias("b")))
    return code, F.transform(ends, lambda r: F.struct(r["a"].alias("first_page"), r["b"].alias("last_page"), (r["b"] - r["a"] + 1).alias("n_pages")))


def split_pages(docs: DataFrame, mode: str, argument: str = "", max_characters: int = MAX_EXPRESSION, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """doc_id, group, label, first_page, last_page, n_pages, error_code of ``docs(doc_id, pages)`` split by ``mode``:
    every, half, every2, odd, even, selected (argument: pages) or custom (argument: last pages of groups).

    A group is a run, told by its ends: no mode lists a group's pages, so a split costs its number of groups alone.
    """
    n = F.col("pages").cast("long")
    docs = docs.filter("pages > 0").select("doc_id", "pages")
    group = lambda a, b, k: F.struct(a.cast("long").alias("first_page"), b.cast("long").alias("last_page"), k.cast("long").alias("n_pages"))
    none, code = F.lit(None).cast("string"), F.lit(None).cast("string")
    if mode == "selected":
        found = select_pages_strict(docs.withColumn("expr", F.lit(argument)), max_characters, max_entries)
        rows = found.select("doc_id", F.col("pos").alias("group"), F.col("page").alias("first_page"), F.col("page").alias("last_page"), F.when(F.col("error_code").isNull(), F.lit(1)).cast("long").alias("n_pages"), "error_code")
    elif mode in ("every", "all", "every-page"):
        rows = numbers(docs, n, "group").select("doc_id", "group", F.col("group").alias("first_page"), F.col("group").alias("last_page"), F.lit(1).cast("long").alias("n_pages"), none.alias("error_code"))
    elif mode == "every2":
        rows = numbers(docs, F.ceil(n / 2), "group").withColumns({"first_page": F.col("group") * 2 - 1, "last_page": F.least(F.col("group") * 2, n)})
        rows = rows.select("doc_id", "group", "first_page", "last_page", (F.col("last_page") - F.col("first_page") + 1).alias("n_pages"), none.alias("error_code"))
    else:
        if mode == "odd":
            groups = F.array(group(F.lit(1), n - (n + 1) % 2, F.floor((n + 1) / 2)))
        elif mode == "even":
            groups, code = F.array(group(F.lit(2), n - n % 2, F.floor(n / 2))), F.when(n < 2, "empty-pdf-result")
        elif mode == "half":
            middle = F.ceil(n / 2)
            groups = F.when(n == 1, F.array(group(n, n, n))).otherwise(F.array(group(F.lit(1), middle, middle), group(middle + 1, n, n - middle)))
        elif mode == "custom":
            code, groups = custom_groups(n, argument, max_characters, max_entries)
        else:
            raise ValueError(f"unknown split mode {mode!r}")
        parts = docs.select("doc_id", code.alias("error_code"), F.when(code.isNull(), groups).alias("groups"))
        rows = parts.select("doc_id", "error_code", F.posexplode_outer("groups").alias("g", "r")).select("doc_id", (F.col("g") + 1).cast("long").alias("group"), "r.first_page", "r.last_page", "r.n_pages", "error_code")
    first, last = F.col("first_page").cast("string"), F.col("last_page").cast("string")
    label = F.lit(f"{mode}-pages") if mode in ("odd", "even") else F.when(F.col("n_pages") == 1, F.concat(F.lit("page-"), first)).otherwise(F.concat_ws("-", F.lit("pages"), first, last))
    return rows.select("doc_id", "group", F.when(F.col("error_code").isNull(), label).alias("label"), "first_page", "last_page", "n_pages", "error_code")


def merge_docs(files: DataFrame) -> DataFrame:
    """``files(job_id, seq, doc_id, pages)`` with start_page and end_page in the merged output, and total_pages."""
    order = Window.partitionBy("job_id").orderBy("seq")
    end = F.sum("pages").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return files.select("job_id", "seq", "doc_id", "pages", (end - F.col("pages") + 1).alias("start_page"), end.alias("end_page"), F.sum("pages").over(Window.partitionBy("job_id")).alias("total_pages"))


def merged_pages(files: DataFrame, pages: DataFrame) -> DataFrame:
    """job_id, output_page, doc_id, page, text of the merged jobs."""
    plan = merge_docs(files).select("job_id", "doc_id", "start_page")
    return plan.join(pages.select("doc_id", "page", "text"), "doc_id").select("job_id", (F.col("start_page") + F.col("page") - 1).alias("output_page"), "doc_id", "page", "text")


def interleave_docs(files: DataFrame, reverse_backs: bool = False) -> DataFrame:
    """job_id, output_page, file_index, page_index, error_code of ``files(job_id, seq, pages)``: the fronts' and the
    backs' pages in turn. A job of other than two files, or of unequal page counts, has one row with a code."""
    jobs = files.groupBy("job_id").agg(F.count("*").alias("n"), F.min_by("pages", "seq").alias("front"), F.max_by("pages", "seq").alias("back"))
    code = F.when(F.col("n") != 2, "interleave-file-count").when(F.col("front") != F.col("back"), "interleave-page-count")
    rows = jobs.withColumn("error_code", code)
    good = rows.filter("error_code IS NULL").select("job_id", "front", F.explode(F.sequence(F.lit(0), F.col("front") - 1)).alias("i"))
    other = F.col("front") - F.col("i") - 1 if reverse_backs else F.col("i")
    sides = F.array(F.struct((F.col("i") * 2 + 1).alias("output_page"), F.lit(0).alias("file_index"), F.col("i").cast("long").alias("page_index")), F.struct((F.col("i") * 2 + 2).alias("output_page"), F.lit(1).alias("file_index"), other.cast("long").alias("page_index")))
    good = good.select("job_id", F.inline(sides)).withColumn("error_code", F.lit(None).cast("string"))
    return good.unionByName(rows.filter("error_code IS NOT NULL").select("job_id", "error_code"), allowMissingColumns=True)


def number_pages(pages: DataFrame, start: int = 1) -> DataFrame:
    return pages.select("doc_id", "page", (F.row_number().over(Window.partitionBy("doc_id").orderBy("page")) + (start - 1)).alias("number"))


def rotate_pages(meta: DataFrame, angle: int) -> DataFrame:
    """``meta(doc_id, page, rotation, width, height)`` turned by ``angle``: the new rotation and shown size."""
    turned = F.pmod(F.col("rotation") + angle, F.lit(360))
    swap = F.pmod(F.lit(angle), F.lit(180)) == 90
    return meta.select("doc_id", "page", turned.alias("rotation"), F.when(swap, F.col("height")).otherwise(F.col("width")).alias("width"), F.when(swap, F.col("width")).otherwise(F.col("height")).alias("height"))


def scope_pages(pages: DataFrame, scope: str, number: int = 1) -> DataFrame:
    """The pages of a scope: ``all``, ``page`` (the one with ``number``), or ``last`` of each document."""
    if scope == "all":
        return pages
    if scope == "page":
        return pages.filter(F.col("page") == number)
    if scope == "last":
        last = pages.groupBy("doc_id").agg(F.max("page").alias("page"))
        return pages.join(last, ["doc_id", "page"], "left_semi")
    raise ValueError(f"unknown scope {scope!r}")


def project_size(pages: DataFrame) -> DataFrame:
    """doc_id, pages, sampled, projected, lower, upper of ``pages(doc_id, page, size)``, from each document's
    first, middle and last page."""
    n = pages.groupBy("doc_id").agg(F.max("page").alias("pages"))
    middle = F.ceil(F.col("pages") / 2)
    sample = pages.join(n, "doc_id").filter((F.col("page") == 1) | (F.col("page") == F.col("pages")) | (F.col("page") == middle))
    facts = sample.groupBy("doc_id", "pages").agg(F.count("*").alias("sampled"), F.sum("size").alias("s"), F.min("size").alias("lo"), F.max("size").alias("hi"))
    average = F.col("s") / F.col("sampled")
    projected = F.ceil(average * F.col("pages") + 4096 + F.col("pages") * 1200)
    spread = F.when(average > 0, (F.col("hi") - F.col("lo")) / average).otherwise(0.0)
    doubt = F.when(F.col("sampled") >= F.col("pages"), 0.08).otherwise(F.least(F.lit(0.4), F.greatest(F.lit(0.15), spread * 0.5)))
    out = facts.select("doc_id", "pages", "sampled", projected.alias("projected"), doubt.alias("doubt"))
    return out.select("doc_id", "pages", "sampled", "projected", F.greatest(F.lit(1), F.floor(F.col("projected") * (1 - F.col("doubt")))).alias("lower"), F.ceil(F.col("projected") * (1 + F.col("doubt"))).alias("upper"))


def page_rows(diff: DataFrame, rows: int = 80, changes_only: bool = False) -> DataFrame:
    """``diff(pair_id, ord, kind, ...)`` with the view page of each row; all rows, or only the changed ones."""
    shown = diff.filter("kind <> 'unchanged'") if changes_only else diff
    return shown.withColumn("view_page", F.ceil(F.row_number().over(Window.partitionBy("pair_id").orderBy("ord")) / rows))
