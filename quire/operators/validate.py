"""Admission, budgets and audits: every rule gives a nullable code, and no bad row stops a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import joined, trimmed

# Limits in bytes, patterns of credentials, paths that must not be published, characters beyond
# Latin-1 that the standard font has, other names of tools, and the wording of rejections.
MIB = 1024**2
ARCHIVE = {"max_entries": 100_000, "max_item": 512 * MIB, "max_total": 2048 * MIB, "ratio": 1000, "ratio_floor": 64 * MIB}
CREDENTIALS = {
    "private-key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "github-fine-grained": r"\bgithub_pat_[A-Za-z0-9_]{40,}\b",
    "github": r"\bgh[pousr]_[A-Za-z0-9]{20,}\b",
    "npm": r"\bnpm_[A-Za-z0-9]{30,}\b",
    "sk": r"\bsk-[A-Za-z0-9_-]{20,}\b",
    "aws": r"\bAKIA[0-9A-Z]{16}\b",
    "google": r"\bAIza[0-9A-Za-z_-]{35}\b",
    "slack": r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    "url-password": r"://[^/\s:]+:[^/@\s]+@",
}
FORBIDDEN = (r"(^|/)\.DS_Store$", r"(^|/)\.env(?:\.|$)", r"(^|/)\.npmrc$", r"(^|/)coverage/", r"(^|/)design-qa(?:-[^/]*)?\.(?:md|png)$", r"(^|/)dist/", r"(^|/)node_modules/", r"(^|/)playwright-report/", r"(^|/)test-results/", r"(^|/)\.vercel/")
SENSITIVE = (r"(?i)(^|/)(?:id_rsa|id_ed25519)$", r"(?i)(^|/)(?:credentials|service-account)(?:\.[^/]*)?\.json$", r"(?i)\.(?:key|p12|pfx|pem)$")
WIN_ANSI_EXTRA = "ŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™"
ALIASES = {"convert-to-jpg": "convert-image", "remove-pages": "remove-pdf-pages", "extract-pages": "extract-pdf-pages", "add-page-numbers": "add-pdf-page-numbers", "ai-summarizer": "summarize-pdf", "remove-background": "remove-image-background"}
REJECTION_TEXTS = {
    "unsupported-type": (" unsupported type", " unsupported types"),
    "file-too-large": (" over the per-file size limit",) * 2,
    "total-too-large": (" over the combined-size limit",) * 2,
    "too-many-files": (" over the file-count limit",) * 2,
    "empty-file": (" empty file", " empty files"),
    "invalid-size": (" with an unreadable size", " with unreadable sizes"),
}


def stateless_code(suffixes: list[str] | None, max_file: float | None) -> Column:
    size, name = F.col("size"), F.lower(F.coalesce("name", F.lit("")))
    known = F.lit(True) if suffixes is None else F.greatest(*[name.endswith(s.lower()) for s in suffixes], F.lit(False))
    code = F.when(size.isNull() | F.isnan(size) | (size < 0) | (size == float("inf")), "invalid-size").when(size == 0, "empty-file").when(~known, "unsupported-type")
    return code if max_file is None else code.when(size > max_file, "file-too-large")


def admit_files(files: DataFrame, suffixes: list[str] | None = None, max_files: int | None = None, max_file: float | None = None, max_total: float | None = None) -> DataFrame:
    """``files(job_id, seq, name, size)`` with error_code, accepted and the running bytes after each file.

    Rules that need one file alone are columns. Without ``max_total`` the count is a window; with it, whether a
    file fits depends on which before it did: jobs' files stream in order, with a count and a sum as their state.
    """
    coded = files.select("job_id", "seq", "name", "size", stateless_code(suffixes, max_file).alias("code"))
    order = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    if max_total is None:
        nth = F.sum(F.col("code").isNull().cast("int")).over(order)
        code = F.col("code") if max_files is None else F.coalesce("code", F.when(nth > max_files, "too-many-files"))
        coded = coded.withColumn("error_code", code)
        return coded.select("job_id", "seq", "name", "size", "error_code", F.col("error_code").isNull().alias("accepted"), F.sum(F.when(F.col("error_code").isNull(), F.col("size")).otherwise(0.0)).over(order).alias("running_bytes"))

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, n, total = None, 0, 0.0
        for batch in batches:
            codes, totals = [], []
            for key, size, code in zip(*(batch[c].to_pylist() for c in ("job_id", "size", "code")), strict=True):
                if key != job:
                    job, n, total = key, 0, 0.0
                if code is None:
                    code = "too-many-files" if max_files is not None and n >= max_files else "total-too-large" if total + size > max_total else None
                    n, total = (n + 1, total + size) if code is None else (n, total)
                codes.append(code)
                totals.append(total)
            yield pa.record_batch([*(batch[c] for c in ("job_id", "seq", "name", "size")), pa.array(codes, pa.string()), pa.array([c is None for c in codes]), pa.array(totals, pa.float64())], [*names, "error_code", "accepted", "running_bytes"])

    names = ["job_id", "seq", "name", "size"]
    sizes = coded.withColumn("size", F.col("size").cast("double"))
    kinds = ", ".join(f"{c} {sizes.schema[c].dataType.simpleString()}" for c in names)
    return sizes.repartition("job_id").sortWithinPartitions("job_id", "seq").mapInArrow(greedy, f"{kinds}, error_code string, accepted boolean, running_bytes double")


def rejection_summary(admitted: DataFrame) -> DataFrame:
    """job_id, accepted, rejected, message: counts by code, in the order in which the codes came up."""
    jobs = admitted.groupBy("job_id").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))
    codes = admitted.filter("NOT accepted").groupBy("job_id", "error_code").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    text = F.lit(" outside this tool’s limits")
    for code, (one, more) in REJECTION_TEXTS.items():
        text = F.when(F.col("error_code") == code, F.when(F.col("n") == 1, one).otherwise(more)).otherwise(text)
    reasons = codes.groupBy("job_id").agg(joined(F.collect_list(F.struct("first", F.concat(F.col("n").cast("string"), text).alias("s"))), "s", ", ").alias("reasons"))
    added = F.when(F.col("accepted") > 0, F.concat(F.col("accepted").cast("string"), F.when(F.col("accepted") == 1, " file was added; ").otherwise(" files were added; "))).otherwise("")
    message = F.concat(added, F.col("rejected").cast("string"), F.when(F.col("rejected") == 1, " file was").otherwise(" files were"), F.lit(" not added: "), F.col("reasons"), F.lit("."))
    return jobs.join(reasons, "job_id", "left").select("job_id", "accepted", "rejected", F.when(F.col("rejected") > 0, message).otherwise("").alias("message"))


def resolve_policy(tools: DataFrame, profiles: DataFrame, defaults: dict[str, float | None]) -> DataFrame:
    """``tools(slug)`` with every limit: the profile's where it has one, else the default; null is no limit.
    Slugs with another name are looked up under it."""
    alias = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    named = tools.select("slug", F.coalesce(F.try_element_at(alias, F.col("slug")), F.col("slug")).alias("key"))
    wide = profiles.groupBy(F.col("slug").alias("key")).agg(*[F.max(F.when(F.col("limit") == k, F.col("value"))).alias(k) for k in defaults])
    return named.join(wide, "key", "left").select("slug", "key", *[F.coalesce(F.col(k), F.lit(v).cast("double")).alias(k) for k, v in defaults.items()])


def check_min_files(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """job_id, n_files, shortfall, error_code of ``jobs(job_id, min_files)``; jobs without files appear."""
    counts = files.groupBy("job_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return jobs.join(counts, "job_id", "left").select("job_id", n.alias("n_files"), F.greatest(F.lit(0), F.col("min_files") - n).alias("shortfall"), F.when(n < F.col("min_files"), "not-enough-files").alias("error_code"))


def preflight_totals(meta: DataFrame, max_pages: int, max_pages_total: int, max_pixels_total: int) -> DataFrame:
    """job_id, total_pages, total_pixels, first_seq, error_code of ``meta(job_id, seq, pages, width, height)``:
    the first item that breaks a limit of its own or of the running totals."""
    order = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    pixels = F.col("width") * F.col("height")
    running = meta.select("job_id", "seq", "pages", pixels.alias("pixels"), F.sum("pages").over(order).alias("p"), F.sum(pixels).over(order).alias("x"))
    code = F.when(F.col("pages") < 1, "invalid-page-count").when(F.col("pages") > max_pages, "too-many-pages").when(F.col("p") > max_pages_total, "too-many-total-pages").when(F.col("x") > max_pixels_total, "too-many-total-pixels")
    facts = running.withColumn("code", code).groupBy("job_id").agg(F.sum("pages").alias("total_pages"), F.sum("pixels").alias("total_pixels"), F.min(F.when(F.col("code").isNotNull(), F.struct("seq", "code"))).alias("bad"))
    return facts.select("job_id", "total_pages", "total_pixels", F.col("bad.seq").alias("first_seq"), F.col("bad.code").alias("error_code"))


def result_budget(results: DataFrame, max_items: int, max_item: float, max_total: float) -> DataFrame:
    """``results(job_id, seq, size)`` with retained and error_code: what comes before a job's first violation is
    kept, the violation has the code, what follows neither."""
    order = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    bad_size = F.col("size").isNull() | F.isnan("size") | (F.col("size") < 0) | (F.col("size") != F.floor("size"))
    code = F.when(bad_size, "invalid-result-size").when(F.col("nth") > max_items, "result-count-limit").when(F.col("size") > max_item, "archive-item-too-large").when(F.col("total") > max_total, "archive-input-too-large")
    coded = results.select("job_id", "seq", "size", F.count("*").over(order).alias("nth"), F.sum("size").over(order).alias("total")).withColumn("code", code)
    broken = F.count("code").over(order)
    return coded.withColumn("broken", broken).select("job_id", "seq", "size", (F.col("broken") == 0).alias("retained"), F.when((F.col("broken") == 1) & F.col("code").isNotNull(), F.col("code")).alias("error_code"))


def screen_archives(entries: DataFrame, files: DataFrame, policy: dict = ARCHIVE) -> DataFrame:
    """file_id, n_entries, expanded, error_code of ``files(file_id, size)`` by their ``entries(file_id, name, size)``."""
    path = F.exists(F.split("name", r"[\\/]", -1), lambda p: p == "..")
    bad = F.isnan("size") | (F.col("size") < 0)
    facts = entries.groupBy("file_id").agg(F.count("*").alias("n"), F.sum("size").alias("expanded"), F.max("size").alias("largest"), F.coalesce(F.bool_or(path), F.lit(False)).alias("unsafe"), F.coalesce(F.bool_or(bad), F.lit(False)).alias("bad"))
    expanded = F.coalesce("expanded", F.lit(0.0))
    code = (
        F.when(F.col("n") > policy["max_entries"], "archive-entry-limit").when(F.col("unsafe"), "unsafe-archive-path").when(F.col("bad"), "invalid-archive-entry").when(F.col("largest") > policy["max_item"], "archive-entry-too-large")
        .when(expanded > policy["max_total"], "archive-expansion-limit").when((F.col("f_size") > 0) & (expanded > F.greatest(F.lit(float(policy["ratio_floor"])), F.col("f_size") * policy["ratio"])), "archive-ratio-limit")
    )
    return files.select("file_id", F.col("size").alias("f_size")).join(facts, "file_id", "left").select("file_id", F.coalesce("n", F.lit(0)).alias("n_entries"), expanded.alias("expanded"), code.alias("error_code"))


def check_settings(options: DataFrame, ranges: DataFrame) -> DataFrame:
    """``options(job_id, tool, key, value)`` with error_code: not a number, under or over the range of its key
    (``ranges(tool, key, low, high)``); keys without a range pass."""
    low, high = F.col("low"), F.col("high")
    number = F.col("value").try_cast("double")
    code = F.when(low.isNull() & high.isNull(), None).when(number.isNull() | F.isnan(number), "invalid-number").when(number < low, "below-minimum").when(number > high, "above-maximum")
    return options.join(ranges, ["tool", "key"], "left").select("job_id", "tool", "key", "value", code.alias("error_code"))


def check_text_lengths(texts: DataFrame, max_characters: int, max_total: int) -> DataFrame:
    """``texts(job_id, seq, text)`` with characters, the job's running characters, and error_code."""
    n = F.length(F.coalesce("text", F.lit("")))
    running = F.sum(n).over(Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    out = texts.select("job_id", "seq", n.alias("characters"), running.alias("running"))
    return out.withColumn("error_code", F.when(F.col("characters") > max_characters, "text-setting-too-long").when(F.col("running") > max_total, "extracted-text-limit"))


def unsupported_chars(docs: DataFrame, keep: int = 5) -> DataFrame:
    """doc_id, ord, character, code: the first ``keep`` different characters of a text that the standard Latin
    font can't show."""
    odd = rf"[^\t\n\r\x20-\x7e\u00a0-\u00ff{WIN_ANSI_EXTRA}]"
    found = docs.select("doc_id", F.posexplode(F.array_distinct(F.regexp_extract_all("text", F.lit(odd), F.lit(0)))).alias("ord", "character")).filter(F.col("ord") < keep)
    number = F.hex(F.conv(F.hex(F.encode("character", "UTF-32")), 16, 10).cast("long"))
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    return found.select("doc_id", (F.col("ord") + 1).alias("ord"), "character", F.concat(F.lit("U+"), padded).alias("code"))


def duplicate_keys(rows: DataFrame, group: str, key: str) -> DataFrame:
    """group, key, n, problem: keys that are missing or empty, or stand more than once in their group."""
    counts = rows.groupBy(group, F.coalesce(key, F.lit("")).alias(key)).agg(F.count("*").alias("n"))
    return counts.filter((F.col("n") > 1) | (F.col(key) == "")).withColumn("problem", F.when(F.col(key) == "", "empty").otherwise("duplicate"))


def scan_credentials(docs: DataFrame) -> DataFrame:
    """doc_id, rule: the high-confidence credential patterns that a text matches."""
    hits = F.array(*[F.when(F.col("text").rlike(pattern), F.lit(rule)) for rule, pattern in CREDENTIALS.items()])
    return docs.select("doc_id", F.explode(F.array_compact(hits)).alias("rule"))


def audit_paths(files: DataFrame) -> DataFrame:
    """``files(path, size)`` with forbidden, sensitive and size_level (``warning`` from 50 MiB, ``error`` from 100)."""
    any_of = lambda patterns: F.greatest(*[F.col("path").rlike(p) for p in patterns])
    return files.select("path", "size", any_of(FORBIDDEN).alias("forbidden"), any_of(SENSITIVE).alias("sensitive"), F.when(F.col("size") >= 100 * MIB, "error").when(F.col("size") >= 50 * MIB, "warning").alias("size_level"))


def audit_summary(audited: DataFrame) -> DataFrame:
    return audited.agg(F.count("*").alias("files"), F.sum("size").alias("total"), F.max(F.struct("size", "path")).alias("m"), F.count_if("forbidden").alias("forbidden"), F.count_if("sensitive").alias("sensitive"), F.count("size_level").alias("size_issues")).select("files", "total", F.col("m.path").alias("largest_path"), F.col("m.size").alias("largest"), "forbidden", "sensitive", "size_issues")


def link_targets(docs: DataFrame, pattern: str = r'href="([^"]*)"', text: str = "html") -> DataFrame:
    """doc_id, target, kind, path: external, anchor, rooted or local links, without fragment and query."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))).alias("raw"))
    target = F.regexp_extract(trimmed(F.col("raw")), r"^\S+", 0)
    kind = F.when(target.startswith("#"), "anchor").when(target.startswith("/"), "rooted").when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), "external").otherwise("local")
    return found.select("doc_id", target.alias("target"), kind.alias("kind"), F.regexp_extract(target, "^[^#?]*", 0).alias("path")).filter("target <> ''")


def check_links(links: DataFrame, targets: DataFrame, kinds: tuple[str, ...] = ("local",)) -> DataFrame:
    """doc_id, path of links to places that aren't among ``targets(path)``."""
    return links.filter(F.col("kind").isin(*kinds) & (F.col("path") != "")).select("doc_id", "path").distinct().join(targets.select("path").distinct(), "path", "left_anti").select("doc_id", "path")


def check_placements(placements: DataFrame, assets: DataFrame, docs: DataFrame) -> DataFrame:
    """``placements(doc_id, ord, asset_id, page_index, x, y, width, rotation, opacity)`` with error_code."""
    x, y, w, r, o = (F.col(c) for c in ("x", "y", "width", "rotation", "opacity"))
    finite = F.greatest(*[v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) for v in (x, y, w, r, o)])
    wrong = finite | ~x.between(0, 1) | ~y.between(0, 1) | ~w.between(0.02, 1) | (x + w > 1.000001) | ~r.between(-180, 180) | ~o.between(0.1, 1)
    known = assets.select("doc_id", "asset_id").distinct().withColumn("known", F.lit(True))
    code = F.when(F.col("known").isNull(), "missing-overlay-image").when(F.col("pages").isNull() | F.col("page_index").isNull() | ~F.col("page_index").between(0, F.col("pages") - 1), "invalid-overlay-page").when(wrong, "invalid-overlay-placement")
    return placements.join(known, ["doc_id", "asset_id"], "left").join(docs.select("doc_id", "pages"), "doc_id", "left").select("doc_id", "ord", "asset_id", code.alias("error_code"))


# Elements that go whole, remote and presentation attributes, and inline images that stay.
BLOCKED = "base|canvas|embed|form|iframe|link|meta|noscript|object|script|style|template"
REMOTE = ("action", "background", "formaction", "href", "ping", "poster", "srcset", "xlink:href")
PRESENTATION = ("class", "contenteditable", "id", "style", "xml:base")
DATA_IMAGE = r"(?i)^data:image/(?:gif|jpe?g|png|webp);base64,[a-z0-9+/]+={0,2}$"


def sanitize_report(pages: DataFrame) -> DataFrame:
    """page_id, removed_elements, removed_attributes, removed_resources, kept_images of each page's open tags:
    blocked elements go whole; of the others, event handlers, presentation and remote attributes go."""
    tags = pages.select("page_id", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"<[A-Za-z][^<>]*>"), F.lit(0))).alias("tag"))
    tags = tags.withColumn("name", F.lower(F.regexp_extract("tag", r"^<([A-Za-z][A-Za-z0-9:-]*)", 1)))
    blocked = F.col("name").rlike(f"^(?:{BLOCKED})$")
    named = tags.filter(~blocked).select("page_id", "name", F.explode(F.regexp_extract_all("tag", F.lit(r"""\s([A-Za-z][A-Za-z0-9:_-]*\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))"""), F.lit(1))).alias("pair"))
    attribute, value = F.lower(F.regexp_extract("pair", r"^[^\s=]+", 0)), trimmed(F.regexp_replace(F.regexp_extract("pair", r"(?s)=\s*(.*)$", 1), r"""^["']|["']$""", ""))
    facts = named.select("page_id", "name", attribute.alias("a"), value.alias("v"))
    url = F.col("v").rlike(r"""(?i)url\s*\(\s*["']?\s*[^#"'\s)]""")
    src_kept = (F.col("a") == "src") & (F.col("name") == "img") & F.col("v").rlike(DATA_IMAGE)
    goes = F.col("a").startswith("on") | F.col("a").isin(*PRESENTATION) | F.when(F.col("a") == "src", ~src_kept).otherwise(F.col("a").isin(*REMOTE) | url)
    counts = facts.groupBy("page_id").agg(F.count_if(goes).alias("removed_attributes"), F.count_if(goes & (F.col("a").isin("src", *REMOTE) | url)).alias("removed_resources"), F.count_if(src_kept).alias("kept_images"))
    elements = tags.groupBy("page_id").agg(F.count_if(blocked).alias("removed_elements"))
    return pages.select("page_id").join(elements, "page_id", "left").join(counts, "page_id", "left").na.fill(0).select("page_id", "removed_elements", "removed_attributes", "removed_resources", "kept_images")
