"""Output names, ranked search, facets and histories."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import WS, WS_SIGNS, once, trimmed, utf8_size

MAX_BYTES, MAX_CHARACTERS = 180, 100
# Extensions that a name may lose, and the word that each operation adds.
KNOWN_EXTENSION = r"(?i)\.(?:pdf|zip|jpe?g|png|webp|gif|tiff?|bmp|svg|heic|avif|txt|md|html?|docx?|pptx?|xlsx?|csv)$"
PAGE_LABEL = r"(?i)-(?:page-[0-9]+|pages-[0-9]+(?:-[0-9]+)?|odd-pages|even-pages)$"
OPERATIONS = {
    "merge-pdf": "merged", "split-pdf": "split", "compress-pdf": "compressed", "organize-pdf": "organized", "remove-pages": "pages-removed", "remove-pdf-pages": "pages-removed",
    "extract-pages": "extracted-pages", "extract-pdf-pages": "extracted-pages", "rotate-pdf": "rotated", "edit-pdf": "edited", "add-image-to-pdf": "with-images", "add-pdf-page-numbers": "numbered",
    "add-page-numbers": "numbered", "watermark-pdf": "watermarked", "sign-pdf": "signed", "redact-pdf": "redacted", "crop-pdf": "cropped", "protect-pdf": "protected", "unlock-pdf": "unlocked",
    "repair-pdf": "repaired", "scan-to-pdf": "scanned", "jpg-to-pdf": "images", "compare-pdf": "comparison", "pdf-to-pdfa": "archive", "pdf-to-jpg": "pages", "pdf-forms": "filled", "fill-pdf": "filled",
    "compress-image": "compressed", "resize-image": "resized", "upscale-image": "upscaled", "remove-background": "background-removed", "remove-image-background": "background-removed",
    "blur-face": "face-blurred", "watermark-image": "watermarked", "meme-generator": "meme", "rotate-image": "rotated", "crop-image": "cropped", "photo-editor": "edited", "convert-from-jpg": "animation",
    "html-to-image": "capture", "ocr-pdf": "text", "ai-summarizer": "summary", "summarize-pdf": "summary", "translate-pdf": "translation",
}


@F.pandas_udf(T.StringType())
def composed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode's composed form; Spark has no function for it."""
    for names in batches:
        yield names.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


def compose_names(df: DataFrame, name: str = "name") -> DataFrame:
    """``df`` with ``name`` in Unicode's composed form. Rows are split, so that ASCII names never leave the JVM
    (a Python function inside a condition would be evaluated for all)."""
    wide = F.coalesce(F.col(name).rlike(r"[^\x00-\x7f]"), F.lit(False))
    return df.filter(~wide).unionByName(df.filter(wide).withColumn(name, composed(name)))


def bounded(name: Column, most: Column | int = MAX_BYTES) -> Column:
    """The longest start of ``name`` with at most ``most`` UTF-8 bytes, without dots, blanks or dashes at its end."""
    most = F.greatest(F.lit(most) if isinstance(most, int) else most, F.lit(0))

    def cut(bytes_: Column) -> Column:
        """A character's first byte is none of 80 to BF; the cut goes before the last one that starts in reach."""
        starts = lambda back: ~F.hex(F.substring(bytes_, most + 1 - back, F.lit(1))).between("80", "BF")
        back = F.when(most < 4, most).otherwise(3)
        for k in (2, 1, 0):
            back = F.when((most >= k) & starts(k), k).otherwise(back)
        return F.substring(bytes_, F.lit(1), most - back).cast("string")

    start = once(F.encode(name, "UTF-8"), lambda b: F.when(F.octet_length(b) <= most, b.cast("string")).otherwise(cut(b)))
    return F.rtrim(start, F.lit(WS_SIGNS + ".-"))


def clean_stem(name: Column, fallback: str = "result") -> Column:
    """A file stem of a composed name (``compose_names``): without control and direction characters, path characters as dashes, blanks single,
    ends bare, reserved device names prefixed, at most MAX_BYTES bytes."""
    text = F.coalesce(name, F.lit(""))
    text = F.regexp_replace(text, r"[\u0000-\u001f\u007f-\u009f\u200e\u200f\u202a-\u202e\u2066-\u2069]", "")
    text = F.regexp_replace(F.regexp_replace(text, r'[<>:"/\\|?*]+', "-"), f"{WS}+", " ")
    text = F.btrim(text, F.lit(WS_SIGNS + ".-"))
    reserved = r"(?i)^(?:con|prn|aux|nul|com[1-9]|lpt[1-9])(?:\.|$)"
    out = bounded(once(text, lambda t: F.when(t.rlike(reserved), F.concat(F.lit("file-"), t)).otherwise(t)))
    return once(out, lambda t: F.when(t == "", fallback).otherwise(t))


def safe_name(name: Column, fallback: str = "result") -> Column:
    """ASCII letters, digits, dots, dashes and underscores alone."""
    out = F.regexp_replace(F.regexp_replace(trimmed(F.coalesce(name, F.lit(""))), r"(?i)[^a-z0-9._-]+", "-"), "^-+|-+$", "")
    return F.when(out == "", fallback).otherwise(out)


def check_names(df: DataFrame) -> DataFrame:
    """``df(id, name)`` with clean (empty for an empty name) and error_code."""
    rows = compose_names(df.select("id", "name").withColumn("given", F.col("name")))
    rows = rows.withColumns({"bare": trimmed(F.coalesce("given", F.lit(""))), "name": trimmed(F.coalesce("name", F.lit("")))})
    rows = rows.withColumn("stem", clean_stem(F.regexp_replace("name", KNOWN_EXTENSION, ""), fallback=""))
    code = F.when((F.length("bare") > MAX_CHARACTERS) | (utf8_size(F.col("bare")) > MAX_BYTES), "output-name-too-long").when((F.col("name") != "") & (F.col("stem") == ""), "invalid-output-name")
    rows = rows.withColumn("error_code", code)
    return rows.select("id", F.col("given").alias("name"), F.when(F.col("error_code").isNull(), F.col("stem")).alias("clean"), "error_code")


def source_names(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """``jobs(job_id, slug, mode)`` with n_files and the stem of the first of their ``files(job_id, seq, name)``."""
    first = files.groupBy("job_id").agg(F.count("*").alias("n_files"), F.min(F.struct("seq", "name")).alias("f")).select("job_id", "n_files", F.col("f.name").alias("name"))
    mode = F.col("mode") if "mode" in jobs.columns else F.lit(None).cast("string")
    both = jobs.select("job_id", "slug", mode.alias("mode")).join(first, "job_id", "left")
    source = F.coalesce(F.col("name"), F.when(F.col("slug").startswith("html-"), "html-document").otherwise("document"))
    return compose_names(both.withColumn("name", source)).withColumn("stem", clean_stem(F.regexp_replace("name", KNOWN_EXTENSION, ""))).drop("name")


def suggest_names(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """job_id, suggestion of ``jobs(job_id, slug)`` from their ``files(job_id, seq, name)``: the first one's stem,
    how many more there are, and the operation, unless the stem ends with it. ``jobs`` may have a ``mode``: a merge
    by ``interleave`` is called so, and its stem loses what names it the front pages."""
    return suggested(source_names(jobs, files)).select("job_id", "suggestion")


def suggested(named: DataFrame) -> DataFrame:
    """``source_names`` with the suggestion."""
    interleaved = F.coalesce((F.col("slug") == "merge-pdf") & (F.col("mode") == "interleave"), F.lit(False))
    bare = F.regexp_replace("stem", r"(?i)[-_ ](?:fronts?|odd)(?:[-_ ]pages)?$", "")
    stem = F.when(interleaved & (bare != ""), bare).otherwise(F.col("stem"))
    word = F.when(interleaved, "interleaved").otherwise(F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in OPERATIONS.items() for x in pair]), F.col("slug")), F.lit("")))
    rows = named.withColumn("short", stem).withColumn("word", word)
    more = F.when(F.col("n_files") > 1, F.concat(F.lit("-and-"), (F.col("n_files") - 1).cast("string"), F.lit("-more"))).otherwise("")
    suffix = F.concat(more, F.when((F.col("word") == "") | F.lower("short").endswith(F.concat(F.lit("-"), F.col("word"))), "").otherwise(F.concat(F.lit("-"), F.col("word"))))
    return rows.withColumn("suggestion", with_label(F.col("short"), suffix)).drop("short", "word")


#: A number of 2 or more as ``unique_names`` writes it.
NUMBERED_STEM = re.compile(r"(?s)(.*)-([2-9]|[1-9][0-9]+)\Z")


def with_label(stem: Column, label: Column) -> Column:
    """A stem with a label behind it, together at most MAX_BYTES bytes."""
    return F.concat(bounded(stem, MAX_BYTES - utf8_size(label)), label)


def name_parts(name: Column) -> tuple[Column, Column]:
    """Stem and lower-case extension (empty, if the name has none of up to eight letters and digits)."""
    pattern = r"(?is)^(.*)\.([a-z0-9]{1,8})$"
    has = name.rlike(pattern)
    return F.when(has, F.regexp_extract(name, pattern, 1)).otherwise(name), F.when(has, F.lower(F.regexp_extract(name, pattern, 2))).otherwise("")


class Taken:
    """Stems of one root that are in use. A stem with a number at its end is that number of the stem before it;
    the numbers of a stem are kept as runs without gaps, ascending, by their first and last ones."""

    def __init__(self) -> None:
        self.bare: set[str] = set()
        self.runs: dict[str, tuple[list[int], list[int]]] = {}

    def place(self, stem: str) -> tuple[str, int]:
        found = NUMBERED_STEM.match(stem)
        return (found[1], int(found[2])) if found else (stem, 0)

    def holds(self, stem: str) -> bool:
        parent, n = self.place(stem)
        if not n:
            return stem in self.bare
        firsts, lasts = self.runs.get(parent, ([], []))
        at = bisect_right(firsts, n) - 1
        return at >= 0 and n <= lasts[at]

    def add(self, stem: str) -> None:
        parent, n = self.place(stem)
        if not n:
            self.bare.add(stem)
            return
        firsts, lasts = self.runs.setdefault(parent, ([], []))
        at = bisect_right(firsts, n)
        after, before = at < len(firsts) and firsts[at] == n + 1, at > 0 and lasts[at - 1] == n - 1
        if after and before:
            lasts[at - 1] = lasts.pop(at)
            firsts.pop(at)
        elif before:
            lasts[at - 1] = n
        elif after:
            firsts[at] = n
        else:
            firsts.insert(at, n)
            lasts.insert(at, n)

    def take(self, stem: str) -> str:
        """What ``stem`` needs behind it to be free, which is then taken: nothing, or the smallest number from 2 on."""
        ending = ""
        if self.holds(stem):
            firsts, lasts = self.runs.get(stem, ([], []))
            ending = f"-{lasts[0] + 1 if firsts and firsts[0] == 2 else 2}"
        self.add(stem + ending)
        return ending


def unique_names(results: DataFrame) -> DataFrame:
    """job_id, seq, name: no two names of a job alike, whatever their case; later ones get the next free number.

    Names can meet only where their stems agree without the numbers at their ends (the root). Where all stems of a
    root are one, a name's number is its place, by a window; only roots with stems that are numbered already are
    gone through in order by Python, streamed sorted. What is used in a root is kept as runs of numbers a stem
    (``Taken``), so a root of any number of names is told by its gaps.
    """
    stem, extension = name_parts(F.coalesce("name", F.lit("result")))
    label = F.regexp_extract(stem, PAGE_LABEL, 0)
    plain = F.regexp_replace(stem, PAGE_LABEL, "")
    rows = compose_names(results.select("job_id", "seq", "name")).select("job_id", "seq", with_label(clean_stem(plain), label).alias("stem"), F.when(extension == "", "").otherwise(F.concat(F.lit("."), extension)).alias("ext"))
    root = F.concat(F.regexp_replace(F.lower("stem"), r"(?:-[0-9]+)+$", ""), F.lit("\n"), F.col("ext"))
    group = Window.partitionBy("job_id", "root")
    rows = rows.withColumn("root", root).withColumn("low", F.lower("stem"))
    rows = rows.withColumn("one", F.min("low").over(group) == F.max("low").over(group)).withColumn("nth", F.row_number().over(group.orderBy("seq")))
    numbered = F.concat("stem", F.when(F.col("nth") > 1, F.concat(F.lit("-"), F.col("nth").cast("string"))).otherwise(""), "ext")
    alone = rows.filter("one").select(F.col("job_id").cast("long").alias("job_id"), F.col("seq").cast("long").alias("seq"), numbered.alias("name"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, taken = None, Taken()
        for batch in batches:
            names = []
            for job, root, stem, ext in zip(*(batch[c].to_pylist() for c in ("job_id", "root", "stem", "ext")), strict=True):
                if (job, root) != key:
                    key, taken = (job, root), Taken()
                names.append(f"{stem}{taken.take(stem.lower())}{ext}")
            yield pa.record_batch([batch["job_id"], batch["seq"], pa.array(names, pa.string())], ["job_id", "seq", "name"])

    met = rows.filter("NOT one").select(F.col("job_id").cast("long").alias("job_id"), F.col("seq").cast("long").alias("seq"), "root", "stem", "ext")
    met = met.repartition("job_id", "root").sortWithinPartitions("job_id", "root", "seq").mapInArrow(number, "job_id long, seq long, name string")
    return alone.unionByName(met)


def number_names(results: DataFrame, custom: str) -> DataFrame:
    """job_id, seq, name: a custom name, the page label where there is one, else a number as wide as the batch
    needs (none in a batch of one)."""
    rows = numbered_results(results)
    label = F.when(F.col("label") != "", F.col("label")).when(F.col("n") > 1, F.concat(F.lit("-"), F.col("place"))).otherwise("")
    custom = unicodedata.normalize("NFC", custom)
    return rows.select("job_id", "seq", F.concat(with_label(clean_stem(F.lit(custom)), label), F.col("ext")).alias("name"))


def numbered_results(results: DataFrame) -> DataFrame:
    """Label, extension, place (as wide as the batch's count) and count of each of ``results(job_id, seq, name)``."""
    stem, extension = name_parts(F.coalesce("name", F.lit("result")))
    n = F.count("*").over(Window.partitionBy("job_id"))
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("seq")).cast("string")
    ext = F.when(extension == "", "").otherwise(F.concat(F.lit("."), extension))
    return results.select("job_id", "seq", "name", F.regexp_extract(stem, PAGE_LABEL, 0).alias("label"), ext.alias("ext"), n.alias("n"), F.lpad(place, F.length(n.cast("string")), F.lit("0")).alias("place"))


# Operations whose single result keeps its page label.
LABELLED = ("split-pdf", "extract-pages", "extract-pdf-pages")


def name_results(jobs: DataFrame, files: DataFrame, results: DataFrame, archive_entries: bool = False) -> DataFrame:
    """job_id, seq, name: how a job's ``results(job_id, seq, name)`` are called, unique within the job.

    ``jobs(job_id, slug, custom)``: with a custom name, all have it, with a number if there are several (entries of
    an archive keep a page label instead). Without one, a single result outside an archive has the suggested name,
    or, of a split or an extraction, the first file's name with the page label; all others keep their own.
    """
    named = suggested(source_names(jobs, files))
    custom = compose_names(jobs.select("job_id", F.coalesce("custom", F.lit("")).alias("custom")), "custom")
    custom = custom.select("job_id", F.when(trimmed(F.col("custom")) != "", clean_stem(F.regexp_replace(trimmed(F.col("custom")), KNOWN_EXTENSION, ""))).alias("custom"))
    rows = numbered_results(results).join(named, "job_id", "left").join(custom, "job_id", "left")
    page = F.col("label") if archive_entries else F.lit("")
    label = F.when(page != "", page).when(F.col("n") > 1, F.concat(F.lit("-"), F.col("place"))).otherwise("")
    single = F.when((F.col("label") != "") & F.col("slug").isin(*LABELLED), with_label(F.col("stem"), F.col("label"))).otherwise(F.col("suggestion"))
    name = F.when(F.col("custom").isNotNull(), F.concat(with_label(F.col("custom"), label), "ext"))
    name = name if archive_entries else name.when((F.col("n") == 1) & single.isNotNull(), F.concat(single, "ext"))
    return unique_names(rows.select("job_id", "seq", name.otherwise(F.col("name")).alias("name")))


def search(items: DataFrame, query: str, k: int = 4) -> DataFrame:
    """rank, pos, name, tier of the best ``k`` of ``items(pos, name, description, tags, category)``: the name itself,
    its start, a part of it, a tag, any other text; ties by position. An empty query has no result."""
    needle = query.strip().lower()
    name, tags = F.lower("name"), F.transform("tags", lambda t: F.lower(t))
    text = F.lower(F.concat_ws(" ", "name", "description", F.array_join("tags", " "), "category"))
    tier = F.when(name == needle, 0).when(name.startswith(needle), 1).when(name.contains(needle), 2).when(F.exists(tags, lambda t: t.startswith(needle)), 3).otherwise(4)
    found = items.filter(F.lit(bool(needle)) & text.contains(needle)).select("pos", "name", tier.alias("tier")).orderBy("tier", "pos").limit(k)
    return found.select(F.row_number().over(Window.orderBy("tier", "pos")).alias("rank"), "pos", "name", "tier")


def facets(items: DataFrame, query: str = "", kind: str | None = None, category: str | None = None) -> DataFrame:
    """kind, category, n: counts of the items that pass the filters, by both, either and none (null: any)."""
    rows = items.filter(F.lower(F.concat_ws(" ", "name", "description")).contains(query.lower())) if query else items
    rows = rows.filter(F.col("kind") == kind) if kind else rows
    rows = rows.filter(F.col("category") == category) if category else rows
    return rows.cube("kind", "category").agg(F.count("*").alias("n"))


def latest_jobs(jobs: DataFrame, keep: int = 8) -> DataFrame:
    """The ``keep`` newest of each user's ``jobs(user_id, job_id, at)``, newest first; ties by the larger job."""
    order = Window.partitionBy("user_id").orderBy(F.desc("at"), F.desc("job_id"))
    return jobs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)
