"""Queries over ordered pages (operators P1 to P14)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quire.operators import compare, pages
from quire.plans import fixtures as fx
from quire.plans.registry import Query

SPLIT_MODES = ("every", "half", "every2", "odd", "even")
MERGE_FILES = fx.LINES + """,
files AS (SELECT doc_id // 4 AS job_id, doc_id % 4 AS seq, doc_id, max(line) AS pages FROM lines GROUP BY ALL)"""


def merge_files(spark, sf):
    """Documents as files of four a job; a page a line."""
    return fx.lines(spark, sf).groupBy("doc_id").agg(F.max("line").alias("pages")).select(F.floor(F.col("doc_id") / 4).alias("job_id"), (F.col("doc_id") % 4).alias("seq"), "doc_id", "pages")


def scan_files(spark, sf):
    """Conversations by twos: fronts and backs of a scan."""
    turns = fx.table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("pages"))
    return turns.select(F.floor(F.col("conv_id") / 2).alias("job_id"), F.col("conv_id").alias("seq"), "pages")


def split_all(spark, sf):
    counts = fx.doc_counts(spark, sf)
    out = None
    for mode in SPLIT_MODES:
        part = pages.split_pages(counts, mode).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


def split_custom(spark, sf):
    counts = fx.doc_counts(spark, sf)
    return pages.split_pages(counts, "custom", "2, 4").withColumn("mode", F.lit("custom")).unionByName(pages.split_pages(counts, "selected", "1,2").withColumn("mode", F.lit("selected")))


STRICT_EXPR = "CASE doc_id % 4 WHEN 0 THEN '1-3' WHEN 1 THEN '3-1,2' WHEN 2 THEN '1,1,1,1,1,1' ELSE '1-99999,x' END"


def limited_counts(spark, sf):
    return fx.doc_counts(spark, sf).withColumn("expr", F.expr(STRICT_EXPR))


def split_limits(spark, sf):
    """Custom splits beyond a limit, with two errors, and halves of documents of 10^9 pages."""
    counts = fx.doc_counts(spark, sf)
    parts = {
        "long": pages.split_pages(counts, "custom", "1,1,1,1,1,1", max_characters=10),
        "large": pages.split_pages(counts, "custom", "2,1,3,x", max_entries=3),
        "first": pages.split_pages(counts, "custom", "1,2,,9"),
        "far": pages.split_pages(counts.withColumn("pages", F.lit(10**9)), "half"),
    }
    return reduce(lambda a, b: a.unionByName(b), [p.withColumn("mode", F.lit(m)) for m, p in parts.items()])


def page_meta(spark, sf):
    return fx.image_meta(spark, sf).select(F.col("image_id").alias("doc_id"), F.lit(1).alias("page"), (F.col("image_id") % 4 * 90).alias("rotation"), "width", "height")


def page_sizes(spark, sf):
    return fx.doc_pages(spark, sf).select("doc_id", "page", (F.length("text") * 100).alias("size"))


def rows_of_diff(spark, sf):
    return pages.page_rows(compare.diff_lines(*fx.diff_inputs(spark, sf)), 80, True)


LABEL = "CASE WHEN mode IN ('odd','even') THEN mode || '-pages' WHEN n = 1 THEN 'page-' || a ELSE 'pages-' || a || '-' || b END"
QUERIES = {
    "p1_select_pages": Query("doc_id:l pos:l page:l", fx.selection, f"WITH {fx.SELECTION}\n--\nSELECT doc_id, pos, page FROM selection"),
    "p1_selection_errors": Query(
        "doc_id:l error_code:s",
        lambda s, d: pages.selection_errors(fx.doc_counts(s, d), 10, 4),
        f"WITH {fx.SELECTION},\n" + """sized AS (SELECT doc_id, sum(CASE WHEN part = '' THEN 0 WHEN contains(part, '-') THEN abs(b - a) + 1 WHEN one BETWEEN 1 AND pages THEN 1 ELSE 0 END) AS n FROM ranges GROUP BY 1),
coded AS (SELECT doc_id, CASE WHEN length(trim(expr)) > 10 THEN 'page-selection-too-long' WHEN lower(trim(expr)) NOT IN ('', 'all') AND n > 4 THEN 'page-selection-too-large' END AS error_code FROM doc_counts LEFT JOIN sized USING (doc_id))
--
SELECT doc_id, error_code FROM coded WHERE error_code IS NOT NULL""",
    ),
    "p2_select_pages_strict": Query(
        "doc_id:l pos:l page:l error_code:s",
        lambda s, d: pages.select_pages_strict(fx.doc_counts(s, d)),
        f"WITH {fx.DOC_COUNTS}," + r"""
sp AS (SELECT doc_id, pages, trim(lower(expr)) AS raw, unnest(string_split(trim(lower(expr)), ',')) AS part, generate_subscripts(string_split(trim(lower(expr)), ','), 1) AS k FROM doc_counts),
se AS (SELECT *, regexp_extract(trim(part), '^([0-9]+)(?:\s*-\s*([0-9]+))?$', 1) AS lo, regexp_extract(trim(part), '^([0-9]+)(?:\s*-\s*([0-9]+))?$', 2) AS hi FROM sp),
sn AS (SELECT *, try_cast(lo AS BIGINT) AS a, try_cast(CASE WHEN hi = '' THEN lo ELSE hi END AS BIGINT) AS b FROM se),
sc AS (SELECT *, CASE WHEN raw = 'all' THEN NULL WHEN raw = '' THEN 'missing-page-selection' WHEN lo = '' THEN 'invalid-page-selection' WHEN least(a, b) < 1 OR greatest(a, b) > pages THEN 'page-out-of-range' END AS code FROM sn),
bad AS (SELECT doc_id, arg_min(code, k) FILTER (WHERE code IS NOT NULL) AS error_code FROM sc GROUP BY 1),
ex AS (SELECT sc.doc_id, k, unnest(CASE WHEN raw = 'all' THEN generate_series(1, pages) WHEN a <= b THEN generate_series(a, b) ELSE generate_series(a, b, -1) END) AS page,
   generate_subscripts(CASE WHEN raw = 'all' THEN generate_series(1, pages) WHEN a <= b THEN generate_series(a, b) ELSE generate_series(a, b, -1) END, 1) AS j FROM sc JOIN bad USING (doc_id) WHERE error_code IS NULL),
ef AS (SELECT doc_id, page, min(k * 100000 + j) AS o FROM ex GROUP BY 1, 2)
--
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS pos, page, NULL AS error_code FROM ef UNION ALL SELECT doc_id, NULL, NULL, error_code FROM bad WHERE error_code IS NOT NULL""",
    ),
    "p2_strict_limits": Query(
        "doc_id:l pos:l page:l error_code:s",
        lambda s, d: pages.select_pages_strict(limited_counts(s, d), 9, 3),
        f"WITH {fx.DOC_COUNTS},\n" + f"e AS (SELECT doc_id, pages, {STRICT_EXPR} AS expr FROM doc_counts)\n" + """--
SELECT doc_id, p AS pos, p AS page, NULL AS error_code FROM (SELECT doc_id, unnest(generate_series(1, 3)) AS p FROM e WHERE expr IN ('1-3', '3-1,2') AND pages >= 3) WHERE doc_id % 4 = 0
UNION ALL SELECT doc_id, p, 4 - p, NULL FROM (SELECT doc_id, unnest(generate_series(1, 3)) AS p FROM e WHERE expr = '3-1,2' AND pages >= 3) WHERE doc_id % 4 = 1
UNION ALL SELECT doc_id, NULL, NULL, 'page-out-of-range' FROM e WHERE expr IN ('1-3', '3-1,2') AND pages < 3
UNION ALL SELECT doc_id, NULL, NULL, 'page-selection-too-long' FROM e WHERE expr = '1,1,1,1,1,1'
UNION ALL SELECT doc_id, NULL, NULL, CASE WHEN pages >= 4 THEN 'page-selection-too-large' ELSE 'page-out-of-range' END FROM e WHERE expr = '1-99999,x'""",
    ),
    "p7_split_limits": Query(
        "mode:s doc_id:l group_no:l label:s first_page:l last_page:l n_pages:l error_code:s",
        lambda s, d: split_limits(s, d).withColumnRenamed("group", "group_no"),
        f"WITH {fx.DOC_COUNTS}\n" + """--
SELECT 'long' AS mode, doc_id, NULL AS group_no, NULL AS label, NULL AS first_page, NULL AS last_page, NULL AS n_pages, 'page-selection-too-long' AS error_code FROM doc_counts
UNION ALL SELECT 'large', doc_id, NULL, NULL, NULL, NULL, NULL, CASE WHEN pages <= 3 THEN 'split-point-out-of-range' ELSE 'page-selection-too-large' END FROM doc_counts
UNION ALL SELECT 'first', doc_id, NULL, NULL, NULL, NULL, NULL, CASE WHEN pages <= 2 THEN 'split-point-out-of-range' ELSE 'invalid-split-point' END FROM doc_counts
UNION ALL SELECT 'far', doc_id, g, CASE WHEN g = 1 THEN 'pages-1-' || 500000000 ELSE 'pages-' || 500000001 || '-' || 1000000000 END, CASE WHEN g = 1 THEN 1 ELSE 500000001 END, 500000000 * g, 500000000, NULL FROM doc_counts, (VALUES (1), (2)) AS v(g)""",
    ),
    "p3_format_selection": Query(
        "doc_id:l ranges:s",
        lambda s, d: pages.format_selection(fx.selection(s, d)),
        f"WITH {fx.SELECTION},\n" + "isl AS (SELECT doc_id, page, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS g FROM firsts), runs AS (SELECT doc_id, min(page) AS a, max(page) AS b FROM isl GROUP BY doc_id, g)\n--\nSELECT doc_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS ranges FROM runs GROUP BY 1",
    ),
    "p4_extract_pages": Query("doc_id:l output:l output_page:l page:l text:s", lambda s, d: pages.extract_pages(fx.doc_pages(s, d), fx.selection(s, d)), f"WITH {fx.SELECTION}\n--\nSELECT doc_id, 1 AS output, pos AS output_page, page, text FROM selection JOIN doc_pages USING (doc_id, page)"),
    "p4_extract_separate": Query("doc_id:l output:l output_page:l page:l text:s", lambda s, d: pages.extract_pages(fx.doc_pages(s, d), fx.selection(s, d), False), f"WITH {fx.SELECTION}\n--\nSELECT doc_id, pos AS output, 1 AS output_page, page, text FROM selection JOIN doc_pages USING (doc_id, page)"),
    "p5_remove_pages": Query(
        "doc_id:l page:l output_page:l text:s error_code:s",
        lambda s, d: pages.remove_pages(fx.doc_pages(s, d), fx.selection(s, d).filter("doc_id % 8 <> 6")),
        f"WITH {fx.SELECTION},\n" + """few AS (SELECT doc_id, page FROM selection WHERE doc_id % 8 <> 6),
verdict AS (SELECT p.doc_id, CASE WHEN count(f.page) = 0 THEN 'missing-page-selection' WHEN count(f.page) >= count(*) THEN 'empty-pdf-result' END AS error_code FROM doc_pages p LEFT JOIN few f USING (doc_id, page) GROUP BY 1)
--
SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS output_page, text, NULL AS error_code FROM doc_pages p JOIN verdict v USING (doc_id) WHERE v.error_code IS NULL AND NOT EXISTS (SELECT 1 FROM few f WHERE f.doc_id = p.doc_id AND f.page = p.page)
UNION ALL SELECT doc_id, NULL, NULL, NULL, error_code FROM verdict WHERE error_code IS NOT NULL""",
    ),
    "p6_organize_pages": Query("doc_id:l outputs:l copied:l omitted:l", lambda s, d: pages.organize_pages(fx.doc_counts(s, d)), f"WITH {fx.SELECTION}\n--\nSELECT doc_id, count(*) AS outputs, count(*) - count(DISTINCT page) AS copied, max(pages) - count(DISTINCT page) AS omitted FROM raw_selection JOIN doc_counts USING (doc_id) GROUP BY 1"),
    "p7_split_pages": Query(
        "mode:s doc_id:l group:l label:s first_page:l last_page:l n_pages:l error_code:s".replace(" group:l", " group_no:l"),
        lambda s, d: split_all(s, d).withColumnRenamed("group", "group_no"),
        f"WITH {fx.DOC_COUNTS},\n" + f"""pg AS (SELECT doc_id, pages, unnest(generate_series(1, pages)) AS p FROM doc_counts),
grp AS (SELECT 'every' AS mode, doc_id, p, p AS g FROM pg UNION ALL SELECT 'half', doc_id, p, CASE WHEN p <= (pages + 1) // 2 THEN 1 ELSE 2 END FROM pg UNION ALL SELECT 'every2', doc_id, p, (p + 1) // 2 FROM pg
 UNION ALL SELECT 'odd', doc_id, p, 1 FROM pg WHERE p % 2 = 1 UNION ALL SELECT 'even', doc_id, p, 1 FROM pg WHERE p % 2 = 0),
agg AS (SELECT mode, doc_id, g, min(p) AS a, max(p) AS b, count(*) AS n FROM grp GROUP BY 1, 2, 3)
--
SELECT mode, doc_id, g AS group_no, {LABEL} AS label, a AS first_page, b AS last_page, n AS n_pages, NULL AS error_code FROM agg UNION ALL SELECT 'even', doc_id, NULL, NULL, NULL, NULL, NULL, 'empty-pdf-result' FROM doc_counts WHERE pages = 1""",
    ),
    "p7_split_custom": Query(
        "mode:s doc_id:l group_no:l label:s first_page:l last_page:l n_pages:l error_code:s",
        lambda s, d: split_custom(s, d).withColumnRenamed("group", "group_no"),
        f"WITH {fx.DOC_COUNTS},\n" + f"""pg AS (SELECT doc_id, pages, unnest(generate_series(1, pages)) AS p FROM doc_counts),
grp AS (SELECT 'custom' AS mode, doc_id, p, CASE WHEN p <= 2 THEN 1 WHEN p <= 4 THEN 2 ELSE 3 END AS g FROM pg WHERE pages > 4 UNION ALL SELECT 'selected', doc_id, p, p FROM pg WHERE pages >= 2 AND p <= 2),
agg AS (SELECT mode, doc_id, g, min(p) AS a, max(p) AS b, count(*) AS n FROM grp GROUP BY 1, 2, 3)
--
SELECT mode, doc_id, g AS group_no, {LABEL} AS label, a AS first_page, b AS last_page, n AS n_pages, NULL AS error_code FROM agg UNION ALL SELECT 'custom', doc_id, NULL, NULL, NULL, NULL, NULL, 'split-point-out-of-range' FROM doc_counts WHERE pages <= 4
UNION ALL SELECT 'selected', doc_id, NULL, NULL, NULL, NULL, NULL, 'page-out-of-range' FROM doc_counts WHERE pages < 2""",
    ),
    "p8_merge_docs": Query("job_id:l seq:l doc_id:l pages:l start_page:l end_page:l total_pages:l", lambda s, d: pages.merge_docs(merge_files(s, d)), f"WITH {MERGE_FILES}\n--\nSELECT job_id, seq, doc_id, pages, sum(pages) OVER w - pages + 1 AS start_page, sum(pages) OVER w AS end_page, sum(pages) OVER (PARTITION BY job_id) AS total_pages FROM files WINDOW w AS (PARTITION BY job_id ORDER BY seq)"),
    "p8_merged_pages": Query("job_id:l output_page:l doc_id:l page:l text:s", lambda s, d: pages.merged_pages(merge_files(s, d), fx.lines(s, d).withColumnRenamed("line", "page")), f"WITH {MERGE_FILES}\n--\nSELECT doc_id // 4 AS job_id, row_number() OVER (PARTITION BY doc_id // 4 ORDER BY doc_id, line) AS output_page, doc_id, line AS page, text FROM lines"),
    "p9_interleave_docs": Query(
        "job_id:l output_page:l file_index:l page_index:l error_code:s",
        lambda s, d: pages.interleave_docs(scan_files(s, d), True),
        """WITH t AS (SELECT conv_id // 2 AS job_id, conv_id, count(*) AS pages FROM conversations GROUP BY 1, 2),
j AS (SELECT job_id, count(*) AS n, arg_min(pages, conv_id) AS f, arg_max(pages, conv_id) AS b FROM t GROUP BY 1),
c AS (SELECT *, CASE WHEN n <> 2 THEN 'interleave-file-count' WHEN f <> b THEN 'interleave-page-count' END AS error_code FROM j), i AS (SELECT job_id, f, unnest(generate_series(0, f - 1)) AS i FROM c WHERE error_code IS NULL)
--
SELECT job_id, 2 * i + 1 AS output_page, 0 AS file_index, i AS page_index, NULL AS error_code FROM i UNION ALL SELECT job_id, 2 * i + 2, 1, f - i - 1, NULL FROM i UNION ALL SELECT job_id, NULL, NULL, NULL, error_code FROM c WHERE error_code IS NOT NULL""",
    ),
    "p10_number_pages": Query("doc_id:l page:l number:l", lambda s, d: pages.number_pages(fx.doc_pages(s, d), 5), f"WITH {fx.DOC_PAGES}\n--\nSELECT doc_id, page, page + 4 AS number FROM doc_pages"),
    "p11_rotate_pages": Query("doc_id:l rotation:l width:l height:l", lambda s, d: pages.rotate_pages(page_meta(s, d), -90), f"WITH {fx.IMAGE_META}\n--\nSELECT image_id AS doc_id, (image_id % 4 * 90 + 270) % 360 AS rotation, height AS width, width AS height FROM image_meta"),
    "p12_scope_pages": Query("doc_id:l page:l text:s", lambda s, d: pages.scope_pages(fx.doc_pages(s, d), "last"), f"WITH {fx.DOC_PAGES}\n--\nSELECT doc_id, page, text FROM doc_pages QUALIFY page = max(page) OVER (PARTITION BY doc_id)"),
    "p13_project_size": Query(
        "doc_id:l pages:l sampled:l projected:l lower:l upper:l",
        lambda s, d: pages.project_size(page_sizes(s, d)),
        f"WITH {fx.DOC_PAGES},\n" + """z AS (SELECT doc_id, page, length(text) * 100 AS size, max(page) OVER (PARTITION BY doc_id) AS pages FROM doc_pages),
f AS (SELECT doc_id, pages, count(*) AS sampled, CAST(sum(size) AS DOUBLE) / count(*) AS av, min(size) AS lo, max(size) AS hi FROM z WHERE page IN (1, pages, (pages + 1) // 2) GROUP BY 1, 2),
g AS (SELECT *, ceil(av * pages + 4096 + pages * 1200) AS projected, CASE WHEN sampled >= pages THEN 0.08::DOUBLE ELSE least(0.4::DOUBLE, greatest(0.15::DOUBLE, CASE WHEN av > 0 THEN (hi - lo) / av ELSE 0 END * 0.5::DOUBLE)) END AS doubt FROM f)
--
SELECT doc_id, pages, sampled, projected, greatest(1, floor(projected * (1 - doubt))) AS lower, ceil(projected * (1 + doubt)) AS upper FROM g""",
    ),
    "p14_page_rows": Query("pair_id:l ord:l kind:s view_page:l", rows_of_diff, f"WITH {fx.SCRIPT}\n--\nSELECT pair_id, ord, kind, (row_number() OVER (PARTITION BY pair_id ORDER BY ord) + 79) // 80 AS view_page FROM script WHERE kind <> 'unchanged'"),
    "p14_numbered_rows": Query(
        "pair_id:l ord:l kind:s view_page:l",
        lambda s, d: pages.page_rows(compare.diff_lines(*fx.numbered_diff_inputs(s, d)), 5, True),
        f"WITH {fx.NUMBERED}\n--\nSELECT pair_id, ord, kind, (row_number() OVER (PARTITION BY pair_id ORDER BY ord) + 4) // 5 AS view_page FROM numbered WHERE kind <> 'unchanged'",
    ),
}
