"""Small cases with results that the rules fix."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quire.functions import text as fn
from quire.operators import compare, forms, images, names, packages, pages, sheets, text, validate
from quire.sources import files


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    ("markup", "expected"),
    [
        ("", ""),
        ("<p>One</p><p>Two &amp; <b>three</b></p>", "One\n\nTwo & three"),
        ("head<body class='x'>a<br>b</body>after", "a\nb"),
        ("<ul><li>x</li><li>y</li></ul>", "- x\n- y"),
        ("<table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>", "1\t2\n3"),
        ("<script>var a = '</b>'; </script>shown<!-- <p>not</p> --><style>p{}</style>", "shown"),
        ("a<script>never closed <p>x</p>", "a"),
        ("<a title='1 > 0'>t</a>", "t"),
        ("x < y and more", "x"),
        ("&lt;p&gt;&#65;&#x42;&nbsp;&middot;&#0;&#1114112;", "<p>AB &middot;��"),
        ("a&#10;b&amp;lt;", "a b&lt;"),
        ("<div>" + "x" * 50 + "<img alt='" + "y" * 200_000 + "'></div>", "x" * 50),
        ("<script src='a'/>kept", "kept"),
        ("one<hr>two", "one\n\ntwo"),
        ("</body>early<body>late</body>x", "late"),
    ],
)
def test_html_text(spark, markup, expected):
    pages = spark.createDataFrame([(1, markup)], "page_id long, html string")
    assert text.html_to_text(pages).first()["text"] == expected


def test_entities(spark):
    assert one(spark, fn.decode_entities, "&amp;amp; &#x1F600; &#8217;&#7;&unknown; &AMP; & &#xD800;") == "&amp; \U0001f600 ’&unknown; & & �"
    assert one(spark, fn.normalized, " a \t\r\n\r\n\r\n b\x00  c\t\td ﻿") == "a\n\nb c\td"


def test_columns_and_sizes(spark):
    assert [one(spark, fn.column_label, i, "long") for i in (0, 25, 26, 51, 701, 702, 16383)] == ["A", "Z", "AA", "AZ", "ZZ", "AAA", "XFD"]
    assert [one(spark, fn.byte_size, b, "long") for b in (0, 512, 1536, 10240, 5 * 2**20)] == ["0 B", "512 B", "1.5 KB", "10 KB", "5.0 MB"]
    assert [one(spark, fn.limit_size, b, "long") for b in (1000, 5 * 2**20, 5 * 2**20 + 2**19)] == ["1 KB", "5 MB", "5.5 MB"]
    assert one(spark, fn.round_half_up, -2.5, "double") == -2


def chosen(spark, expr, n, keep=False):
    docs = spark.createDataFrame([(1, n, expr)], "doc_id long, pages int, expr string")
    return [r["page"] for r in pages.select_pages(docs, keep).orderBy("pos").collect()]


def test_page_selection(spark):
    assert chosen(spark, "1-3, 6, 8-7, 2", 8) == [1, 2, 3, 6, 8, 7]
    assert chosen(spark, None, 2) == [1, 2] and chosen(spark, "all", 2) == [1, 2] and chosen(spark, "x,9", 3) == []
    assert chosen(spark, "3,1,2,2", 4, True) == [3, 1, 2, 2] and chosen(spark, "2-", 4) == [2, 3, 4] and chosen(spark, "-2", 4) == [1, 2]


def strict(spark, expr, n):
    docs = spark.createDataFrame([(1, n, expr)], "doc_id long, pages int, expr string")
    rows = pages.select_pages_strict(docs).orderBy("pos").collect()
    return rows[0]["error_code"] or [r["page"] for r in rows]


def test_strict_selection(spark):
    assert strict(spark, "1-3, 6, 8-7, 2", 8) == [1, 2, 3, 6, 8, 7]
    assert strict(spark, "", 3) == "missing-page-selection" and strict(spark, "1,,2", 3) == "invalid-page-selection" and strict(spark, "2,9", 3) == "page-out-of-range" and strict(spark, "0", 3) == "page-out-of-range"
    assert strict(spark, "9,x", 3) == "page-out-of-range" and strict(spark, "99999999999999999999", 3) == "invalid-page-selection"


def groups(spark, mode, n, argument=""):
    docs = spark.createDataFrame([(1, n)], "doc_id long, pages int")
    rows = pages.split_pages(docs, mode, argument).orderBy("group").collect()
    return rows[0]["error_code"] or [(r["label"], r["n_pages"]) for r in rows]


def test_splits(spark):
    assert groups(spark, "half", 5) == [("pages-1-3", 3), ("pages-4-5", 2)] and groups(spark, "half", 1) == [("page-1", 1)]
    assert groups(spark, "every2", 3) == [("pages-1-2", 2), ("page-3", 1)] and groups(spark, "odd", 3) == [("odd-pages", 2)]
    assert groups(spark, "even", 1) == "empty-pdf-result" and groups(spark, "custom", 5, "2,4") == [("pages-1-2", 2), ("pages-3-4", 2), ("page-5", 1)]
    assert groups(spark, "custom", 5, "2,x") == "invalid-split-point" and groups(spark, "custom", 5, "5") == "split-point-out-of-range"
    with pytest.raises(ValueError):
        groups(spark, "none", 3)


def test_splits_and_selections_of_endless_documents(spark):
    """Groups are runs: 10^9 pages are split without being listed; the first pages of all are there at once."""
    n = 10**9
    assert groups(spark, "half", n) == [("pages-1-500000000", n // 2), ("pages-500000001-1000000000", n // 2)]
    assert groups(spark, "odd", n) == [("odd-pages", n // 2)] and groups(spark, "custom", n, "7, 3") == [("pages-1-3", 3), ("pages-4-7", 4), ("pages-8-1000000000", n - 7)]
    docs = spark.createDataFrame([(1, n, "all")], "doc_id long, pages int, expr string")
    some = pages.split_pages(docs, "every2").limit(3).collect()
    assert [r["last_page"] for r in some] == [2 * r["group"] for r in some]
    some = pages.select_pages_strict(docs).limit(3).collect()
    assert len(some) == 3 and all(r["pos"] == r["page"] for r in some)


def test_limits_of_strict_selections(spark):
    """A range is too large where its pages are too many, not by its text; what is wrong first decides."""
    def code(expr, n, **limits):
        docs = spark.createDataFrame([(1, n, expr)], "doc_id long, pages int, expr string")
        return pages.select_pages_strict(docs, **limits).first()["error_code"]

    n = 10**9
    assert code("1-100000", n) is None and code("1-100001", n) == "page-selection-too-large" and code("100001-1,x", n) == "page-selection-too-large"
    assert code("1-99999,1-100000,5-9", n) is None and code("1-99999,1-100000,100001", n) == "page-selection-too-large"
    assert code("1-1000000000", 150_000) == "page-selection-too-large" and code("1-1000000000", 90_000) == "page-out-of-range"
    assert code("1-4", 9, max_entries=3) == "page-selection-too-large" and code("1-3,2,1", 9, max_entries=3) is None
    assert code("3-9007199254740993", 9) == "invalid-page-selection" and code("1" * 10_001, 9) == "page-selection-too-long"
    rows = lambda argument, n, **limits: pages.split_pages(spark.createDataFrame([(1, n)], "doc_id long, pages int"), "custom", argument, **limits).first()["error_code"]
    assert rows("1,2,3", 9, max_entries=3) == "page-selection-too-large" and rows("1,2,2", 9, max_entries=3) is None and rows("1,9,2,x", 9) == "split-point-out-of-range"
    assert rows("1,x,9", 9) == "invalid-split-point" and rows("0", 9) == "split-point-out-of-range" and rows("1," * 5001 + "1", 9) == "page-selection-too-long"


def test_interleave(spark):
    scans = spark.createDataFrame([(1, 1, 3), (1, 2, 3), (2, 1, 2), (2, 2, 3), (3, 1, 1)], "job_id long, seq int, pages int")
    rows = pages.interleave_docs(scans, True).collect()
    assert sorted((r["output_page"], r["file_index"], r["page_index"]) for r in rows if r["job_id"] == 1) == [(1, 0, 0), (2, 1, 2), (3, 0, 1), (4, 1, 1), (5, 0, 2), (6, 1, 0)]
    assert {r["job_id"]: r["error_code"] for r in rows if r["error_code"]} == {2: "interleave-page-count", 3: "interleave-file-count"}


def test_admission(spark):
    rows = [(1, i, n, s) for i, (n, s) in enumerate([("a.pdf", 6.0), ("b.pdf", 5.0), ("c.PDF", 4.0), ("d.txt", 1.0), ("e.pdf", 0.0), ("f.pdf", None), ("g.pdf", 1.0)])]
    found = validate.admit_files(spark.createDataFrame(rows, "job_id long, seq int, name string, size double"), [".pdf"], None, 100, 10).orderBy("seq").collect()
    assert [r["error_code"] for r in found] == [None, "total-too-large", None, "unsupported-type", "empty-file", "invalid-size", "total-too-large"]
    summary = validate.rejection_summary(spark.createDataFrame(found)).first()
    assert summary["message"] == "2 files were added; 5 files were not added: 2 over the combined-size limit, 1 unsupported type, 1 empty file, 1 with an unreadable size."


def test_result_budget(spark):
    rows = spark.createDataFrame([(1, 1, 5.0), (1, 2, 3.0), (1, 3, 1.0), (2, 1, 6.0)], "job_id long, seq int, size double")
    found = validate.result_budget(rows, 2, 5, 8).orderBy("job_id", "seq").collect()
    assert [(r["retained"], r["error_code"]) for r in found] == [(True, None), (True, None), (False, "result-count-limit"), (False, "archive-item-too-large")]


def test_names(spark):
    rows = [(1, i, n) for i, n in enumerate(["x.pdf", "x-2.pdf", "X.pdf", "x.png", "x.pdf", None])]
    found = names.unique_names(spark.createDataFrame(rows, "job_id long, seq long, name string")).orderBy("seq").collect()
    assert [r["name"] for r in found] == ["x.pdf", "x-2.pdf", "X-3.pdf", "x.png", "x-4.pdf", "result"]
    clean = lambda v: names.compose_names(spark.createDataFrame([(v,)], "name string")).select(names.clean_stem(F.col("name"))).first()[0]
    assert clean("été") == "été" and clean("..a‮b/c..") == "ab-c" and clean("CON.txt") == "file-CON.txt" and clean(None) == "result"
    assert len(clean("界" * 100).encode()) <= 180
    assert one(spark, names.safe_name, "  résumé (1) ") == "r-sum-1"


def test_names_are_worked_out_once(spark):
    """The plan names each step once, and what is cut has the most whole characters that fit."""
    plan = names.check_names(spark.createDataFrame([(1, "a")], "id long, name string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<>:") == 2  # ASCII names and others
    rng = random.Random(5)
    given = ["", "界" * 60 + "x"] + ["".join(rng.choice("aé界𝒳") for _ in range(n)) for n in range(0, 200, 3)]
    for most in (0, 1, 2, 3, 5, 180):
        found = [r[0] for r in spark.createDataFrame([(g,) for g in given], "name string").select(names.bounded(F.col("name"), most)).collect()]
        assert found == [next(g[:n] for n in range(len(g), -1, -1) if len(g[:n].encode()) <= most) for g in given]


def test_ascii_names_stay_in_the_jvm(spark):
    """Only rows that hold another character are sent to Python."""
    rows = spark.createDataFrame([("abc",), ("e\u0301",), (None,)], "name string")
    assert sorted(str(r["name"]) for r in names.compose_names(rows).collect()) == ["None", "abc", "é"]
    plan = names.compose_names(rows.filter("name = 'abc'"))._jdf.queryExecution().executedPlan().toString()
    ascii_side = plan.split("Union")[1].split("ArrowEvalPython")[0]
    assert "NOT coalesce(RLIKE" in ascii_side and plan.count("ArrowEvalPython") == 1


def test_suggestions_and_names_of_results(spark):
    jobs = spark.createDataFrame([(1, "merge-pdf", "interleave", None), (2, "split-pdf", None, None), (3, "merge-pdf", None, " My result.PDF "), (4, "merge-pdf", None, None)], "job_id long, slug string, mode string, custom string")
    files = spark.createDataFrame([(1, 1, "scan_fronts.pdf"), (1, 2, "scan-backs.pdf"), (2, 1, "book.pdf"), (3, 1, "a.pdf"), (4, 1, "odd.pdf"), (4, 2, "x-merged.pdf")], "job_id long, seq int, name string")
    found = {r["job_id"]: r["suggestion"] for r in names.suggest_names(jobs, files).collect()}
    assert found == {1: "scan-and-1-more-interleaved", 2: "book-split", 3: "a-merged", 4: "odd-and-1-more-merged"}
    results = spark.createDataFrame([(1, 1, "out.pdf"), (2, 1, "tmp-page-7.pdf"), (3, 1, "r-page-1.png"), (3, 2, "r.png"), (4, 1, "a.pdf"), (4, 2, "A.pdf")], "job_id long, seq int, name string")
    called = lambda archive: {(r["job_id"], r["seq"]): r["name"] for r in names.name_results(jobs, files, results, archive).collect()}
    assert called(False) == {(1, 1): "scan-and-1-more-interleaved.pdf", (2, 1): "book-page-7.pdf", (3, 1): "My result-1.png", (3, 2): "My result-2.png", (4, 1): "a.pdf", (4, 2): "A-2.pdf"}
    assert called(True) == {(1, 1): "out.pdf", (2, 1): "tmp-page-7.pdf", (3, 1): "My result-page-1.png", (3, 2): "My result-2.png", (4, 1): "a.pdf", (4, 2): "A-2.pdf"}


def test_selections_have_limits(spark):
    docs = spark.createDataFrame([(1, 1_000_000_000, "1-"), (2, 9, "1-3," * 6_000), (3, 9, "1-9,2"), (4, 9, "")], "doc_id long, pages int, expr string")
    assert {r["doc_id"]: r["error_code"] for r in pages.selection_errors(docs).collect()} == {1: "page-selection-too-large", 2: "page-selection-too-long"}
    assert {r["doc_id"]: r["n"] for r in pages.select_pages(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {3: 9, 4: 9}
    assert [r["doc_id"] for r in pages.selection_errors(docs, 10, 8).orderBy("doc_id").collect()] == [1, 2, 3]


def test_long_jobs_are_admitted_in_one_pass(spark):
    """A job of many files costs its own length; nothing of it is held but a count and a sum."""
    files = spark.range(200_000).selectExpr("id % 2 AS job_id", "id AS seq", "'a.pdf' AS name", "double(id % 7) + 1 AS size")
    found = validate.admit_files(files, max_total=1000.0)
    assert found.filter("accepted").groupBy("job_id").agg(F.sum("size").alias("s")).filter("s > 1000").count() == 0
    assert found.count() == 200_000 and found.filter("error_code = 'total-too-large'").count() > 199_000


def test_diff_and_report(spark):
    docs = spark.createDataFrame([(1, "h\nold\nsame"), (2, "h\nnew\nsame\nmore"), (3, "h\nold\nsame\n")], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 1, 2), (2, 1, 3), (3, 1, None)], "pair_id long, left_id long, right_id long")
    diff = compare.diff_lines(pairs, docs)
    rows = [(r["kind"], r["left_line"], r["right_line"], r["text"]) for r in diff.filter("pair_id = 1").orderBy("ord").collect()]
    assert rows == [("unchanged", 1, 1, "h"), ("removed", 2, None, "old"), ("added", None, 2, "new"), ("unchanged", 3, 3, "same"), ("added", None, 4, "more")]
    stats = {r["pair_id"]: r for r in compare.diff_stats(diff).collect()}
    assert (stats[1]["changed_blocks"], stats[1]["changed"], stats[2]["identical"], stats[3]["removed"]) == (3, 3, True, 3)
    report = compare.diff_report_html(spark.createDataFrame([(1, 1, "added", None, 1, "<a & 'b'>")], "pair_id long, ord long, kind string, left_line long, right_line long, text string")).first()["html"]
    assert "<pre>&lt;a &amp; &#039;b&#039;&gt;</pre>" in report and '<span class="marker">+</span>' in report


def test_markdown_blocks(spark):
    source = "# Title\n\npara one\nstill one\n- a\n* b\n1. c\n2) d\n---\n#nospace\n# \nlast"
    rows = text.markdown_blocks(spark.createDataFrame([(1, source)], "doc_id long, markdown string")).orderBy("block").collect()
    assert [(r["type"], r["level"], r["text"], r["items"]) for r in rows] == [
        ("heading", 1, "Title", None),
        ("paragraph", None, "para one\nstill one", None),
        ("list", None, None, ["a", "b"]),
        ("ordered-list", None, None, ["c", "d"]),
        ("divider", None, None, None),
        ("paragraph", None, "#nospace", None),
        ("paragraph", None, "# \nlast", None),
    ]
    cut = text.markdown_blocks(spark.createDataFrame([(1, source)], "doc_id long, markdown string"), max_blocks=2).collect()
    assert len(cut) == 2 and all(r["truncated"] for r in cut)


def test_glossary(spark):
    docs = spark.createDataFrame([(1, "The private document and uncommon file."), (2, "réthe the_ the1 THE")], "doc_id long, text string")
    found = {r["doc_id"]: (r["replacements"], r["body"]) for r in text.apply_glossary(docs, "xx").collect()}
    assert found == {1: (5, "el privado documento y uncommon archivo."), 2: (2, "réel the_ the1 el")}


def test_glossary_of_phrases(spark, monkeypatch):
    """The longest term at a word wins, by either way; odd rows of the glossary don't count."""
    rows = [("XX", "private", "P"), ("xx", "Private  document", "PD"), ("xx", "private document store", "PDS"), ("xx", "the", "z"), ("xx", "THE", "a"), ("es", "file", "F"), ("xx", None, "n"), ("xx", "file", None), ("xx", "a-b", "no"), ("xx", "", "no")]
    table = spark.createDataFrame(rows, "language string, term string, replacement string")
    docs = spark.createDataFrame([(1, "The private\n document, PRIVATE DOCUMENT STORED private document store"), (1, "private. Document file"), (2, None), (None, "xprivate private_ private")], "doc_id long, text string")
    expected = [(1, 4, "a PD, PD STORED PDS"), (1, 1, "P. Document file"), (2, 0, ""), (None, 1, "xprivate private_ P")]
    for limit in (text.MAX_GLOSSARY, 0):
        found = text.apply_glossary(docs, "xX", table, max_bytes=limit)
        assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str) and found.columns == ["doc_id", "replacements", "body"]
        assert {r["body"] for r in text.apply_glossary(docs.filter("doc_id = 1"), "??", table, max_bytes=limit).collect()} == {docs.first()["text"], "private. Document F"}
    assert {r["replacements"] for r in text.apply_glossary(docs, "xx", table.limit(0)).collect()} == {0}


def test_summary_in_its_row(spark):
    """Ties by place, repeats by case once, no exchange of texts."""
    docs = spark.createDataFrame([(1, "Alpha beta gamma. Short. ALPHA BETA GAMMA.\nOther words here! beta"), (2, None), (3, " \n"), (4, "no end")], "doc_id long, text string")
    found = text.summarize(docs, 2, prose=True)
    assert {r["doc_id"]: (r["summary"], r["n_sentences"]) for r in found.collect()} == {1: ("Alpha beta gamma. beta", 2), 4: ("no end", 1)}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_slides_and_words(spark):
    slide = "<p:sld xmlns:a='x'><a:t>  One\n two </a:t><a:t/><b:t>&lt;3</b:t></p:sld>"
    assert one(spark, packages.runs_text, slide) == "One two <3"
    body = (
        "<w:document><w:body><w:p><w:r><w:t>First</w:t><w:tab/><w:t xml:space='preserve'>cell &amp; more</w:t></w:r></w:p><w:p><w:del><w:r><w:delText>gone</w:delText></w:r></w:del>"
        "<mc:AlternateContent><mc:Choice><w:t>no</w:t></mc:Choice><mc:Fallback><w:t>yes</w:t></mc:Fallback></mc:AlternateContent><w:br/><w:noBreakHyphen/><w:sym w:font='W' w:char='F0b7'/><w:sym w:font=\"Wing dings\" w:char=\"f0b7\"/></w:p><w:p/></w:body></w:document>"
    )
    row = packages.word_text(spark.createDataFrame([(1, body)], "doc_id long, xml string")).first()
    assert row["text"] == "First\tcell & more\n\nyes\n‑[symbol][symbol Wing dings F0B7]\n\n" and row["paragraphs"] == 3


def test_workbook(spark):
    cells = [(1, 1, "Summary", 0, 0, "Quarter"), (1, 1, "Summary", 0, 1, "Revenue"), (1, 1, "Summary", 2, 0, "Q2"), (1, 2, "Notes", 3, 2, "x")]
    frame = spark.createDataFrame(cells, "doc_id long, sheet_no int, sheet string, row int, col int, value string")
    assert sheets.workbook_text(frame).first()["text"] == "Summary\nQuarter  |  Revenue\n\nQ2\n\nNotes\nx"
    assert tuple(sheets.workbook_text(frame, 6).first())[1:] == (None, "spreadsheet-cell-limit") and sheets.workbook_text(frame, 7).first()["error_code"] is None


def test_cells_far_apart_cost_what_they_are(spark):
    """Two cells two million rows apart: a gap, not rows; beyond the ceiling a code and no text."""
    cells = [(1, 1, "S", 0, 0, "a"), (1, 1, "S", 2_000_000, 0, "b"), (2, 1, "S", 5, 3, None), (2, 1, "S", 5, 6, "x"), (3, 1, "S", 0, 0, "a"), (3, 2, "T", 2_000_000, 0, "b"), (3, 2, "T", 0, 5, "c")]
    frame = spark.createDataFrame(cells, "doc_id long, sheet_no int, sheet string, row int, col int, value string")
    found = {r["doc_id"]: (r["text"], r["error_code"]) for r in sheets.workbook_text(frame).collect()}
    assert found[1] == ("S\na" + "\n" * 2_000_000 + "b", None) and found[2] == ("S\n  |    |    |  x", None) and found[3] == (None, "spreadsheet-cell-limit")


def test_regions_meet_cells_by_tiles(spark):
    """As cell by cell, with regions and cells on tiles' edges, off the page, and thousands on one page."""
    rng = random.Random(2)
    some = lambda: rng.choice([0.0, 5.0, 12.5, 50.0, 99.99, 100.0, 130.0, rng.uniform(0, 100)])
    areas = [(i % 3, 1, some(), some(), rng.choice([0.5, 5.0, 10.0, 60.0]), rng.choice([0.5, 5.0, 30.0])) for i in range(60)] + [(9, 1, rng.uniform(0, 99), rng.uniform(0, 99), 0.5, 0.5) for _ in range(3000)]
    cells = [(i % 4, 1, rng.choice([-3.0, some()]), some(), i) for i in range(800)] + [(9, 1, rng.uniform(0, 100), rng.uniform(0, 100), i) for i in range(500)]
    regions = spark.createDataFrame([(*a, None) for a in areas], "doc_id long, page int, x double, y double, width double, height double, error_code string")
    found = forms.mask_regions(spark.createDataFrame(cells, "doc_id long, page int, x double, y double, value long"), regions, -1)
    covered = lambda c: any(a[0] == c[0] and a[2] <= c[2] < a[2] + a[4] and a[3] <= c[3] < a[3] + a[5] for a in areas)
    assert sorted(map(tuple, found.collect())) == sorted((*c[:4], -1 if covered(c) else c[4], covered(c)) for c in cells)


def test_pages_of_few_and_many_regions(spark, monkeypatch):
    """Pages with as many regions as are compared at once and with one more, and all by tiles; no side is broadcast."""
    rng = random.Random(3)
    some = lambda: rng.choice([0.0, 5.0, 12.5, 50.0, 99.99, 100.0, 130.0, rng.uniform(0, 100)])
    areas = [(d, 1, some(), some(), rng.choice([0.5, 5.0, 60.0]), rng.choice([0.5, 5.0, 30.0])) for d, n in ((0, 32), (1, 33), (2, 1)) for _ in range(n)]
    cells = [(i % 4, 1, rng.choice([-3.0, some()]), some(), i) for i in range(800)] + [(0, 1, None, 1.0, 1), (1, None, 1.0, 1.0, 2)]
    regions = spark.createDataFrame([(*a, None) for a in areas], "doc_id long, page int, x double, y double, width double, height double, error_code string")
    covered = lambda c: None not in c and any(a[0] == c[0] and a[2] <= c[2] < a[2] + a[4] and a[3] <= c[3] < a[3] + a[5] for a in areas)
    for few in (forms.FEW_REGIONS, 0):
        monkeypatch.setattr(forms, "FEW_REGIONS", few)
        found = forms.mask_regions(spark.createDataFrame(cells, "doc_id long, page int, x double, y double, value long"), regions, -1)
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(str((*c[:4], -1 if covered(c) else c[4], covered(c))) for c in cells)
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_summary_splits_its_text_once(spark):
    """Neither the sentences nor the call that picks them stand in the plan again for the filter."""
    plan = text.summarize(spark.createDataFrame([(1, "One. Two.")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("flatten") == 1 and plan.count("ArrowEvalPython") == 1


def test_reports_are_made_where_lines_meet(spark):
    """As from the rows, without a shuffle of them; a pair that isn't compared has null, two empty texts no row."""
    docs = spark.createDataFrame([(1, "a\n<b>\nc"), (2, "a\nc\nd"), (3, "c\na"), (4, ""), (5, None)], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 1, 2), (2, 1, 1), (3, 1, 4), (4, 4, 5), (5, 1, 3), (6, 9, 2)], "pair_id long, left_id long, right_id long")
    for most in (None, 3):
        rows = sorted(map(tuple, compare.pair_reports(pairs, docs, most).collect()))
        assert rows == sorted(map(tuple, compare.diff_report_html(compare.diff_lines(pairs, docs, most)).collect()))
        assert [r[0] for r in rows] == [1, 2, 3, 5, 6] and [r[0] for r in rows if r[1] is None] == ([] if most is None else [5])
    assert "HashAggregate" not in compare.pair_reports(pairs, docs)._jdf.queryExecution().executedPlan().toString()


def test_labels_past_three_letters(spark):
    """As a spreadsheet goes on; of at most three letters the first goes on, as the query's SQL has it."""
    assert [one(spark, fn.column_label, i, "long") for i in (18277, 18278, 475253, 475254)] == ["ZZZ", "AAAA", "ZZZZ", "AAAAA"]
    three = lambda i: fn.column_label(i, 3)
    assert [one(spark, three, i, "long") for i in (701, 18277, 18278, 1_200_000)] == ["ZZ", "ZZZ", "[AA", chr(65 + (1_200_000 - 702) // 676) + "CW"]


def test_forms(spark):
    rows = spark.createDataFrame([(1, '{"t": "abcdef", "c": true}'), (2, '{"o": ["a", "z"]}'), (3, "[]"), (4, None), (5, '{"t": null}')], "doc_id long, values string")
    values = forms.parse_form_values(rows)
    assert values.filter("doc_id = 3").first()["error_code"] == "invalid-form-values" and values.filter("doc_id = 4").count() == 0
    fields = spark.createDataFrame([(d, n, t, True, False, m, o, "null") for d in (1, 2, 5) for n, t, m, o in (("t", "text", 5, None), ("c", "checkbox", None, None), ("o", "option-list", None, ["a"]))], "doc_id long, name string, type string, supported boolean, read_only boolean, max_length int, options array<string>, current_json string")
    found = {r["doc_id"]: r["error_code"] for r in forms.validate_form(values.filter("error_code IS NULL"), fields).collect()}
    assert found == {1: "value-too-long", 2: "unknown-choice", 5: None}
    applied = {r["name"]: r["value_json"] for r in forms.apply_form_values(fields.filter("doc_id = 5"), values).collect()}
    assert applied == {"t": '""', "c": "null", "o": "null"}


def test_regions(spark):
    rows = spark.createDataFrame([(1, '[{"page":1,"x":10.126,"y":0,"width":5,"height":5},{"page":9,"x":0,"y":0,"width":1,"height":1},{"page":1,"x":0,"y":0,"width":0.1,"height":1}]', 2), (2, "{}", 1), (3, "[", 1), (4, " ", 1)], "doc_id long, regions string, pages int")
    found = [(r["doc_id"], r["x"], r["error_code"]) for r in forms.parse_regions(rows).orderBy("doc_id", "ord").collect()]
    assert found == [(1, 10.13, None), (1, 0.0, "invalid-redaction-page"), (1, 0.0, "redaction-region-out-of-bounds"), (2, None, "invalid-redaction-list"), (3, None, "invalid-redaction-json")]
    assert {r["error_code"] for r in forms.parse_regions(rows.filter("doc_id = 1"), max_regions=2).collect()} == {"too-many-redaction-regions"}


def grid(spark, center):
    rows = [(1, x, y, *(center if (x, y) == (1, 1) else (255, 255, 255)), 255) for x in range(3) for y in range(3)]
    return spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int, a int")


def test_background(spark):
    done = images.remove_background(grid(spark, (10, 20, 30)))
    assert {(r["x"], r["y"]): r["a"] for r in done.collect()}[1, 1] == 255 and done.filter("a = 0").count() == 8
    assert images.background_outcome(done).first()["removed_percent"] == 89
    corners = images.corner_stats(grid(spark, (0, 0, 0))).first()
    assert (corners["hex"], corners["spread"]) == ("#ffffff", 0)
    turned = images.rotate_pixels(grid(spark, (0, 0, 0)).withColumn("r", F.col("x") * 10 + F.col("y")), 90)
    assert {(r["x"], r["y"]): r["r"] for r in turned.collect()}[2, 0] == 0


def test_media_headers(spark):
    png = bytes.fromhex("89504e470d0a1a0a0000000d49484452" + "00000140" + "000000f0")
    lossless = b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + ((99) | (49 << 14)).to_bytes(4, "little")
    lossy = b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0\0\0\0\x9d\x01\x2a" + (640).to_bytes(2, "little") + (480).to_bytes(2, "little")
    rows = [(1, bytearray(png)), (2, bytearray(lossless)), (3, bytearray(lossy)), (4, bytearray(b"%PDF")), (5, None)]
    found = {r["id"]: (r["format"], r["width"], r["height"]) for r in files.sniff_media(spark.createDataFrame(rows, "id long, content binary")).collect()}
    assert found == {1: ("png", 320, 240), 2: ("webp", 100, 50), 3: ("webp", 640, 480), 4: (None, None, None), 5: (None, None, None)}


def test_archives_and_placements(spark):
    entries = spark.createDataFrame([(1, "a/../b", 1.0), (2, "a/..b", 5.0), (3, "x", -1.0)], "file_id long, name string, size double")
    files_ = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0)], "file_id long, size double")
    assert {r["file_id"]: r["error_code"] for r in validate.screen_archives(entries, files_).collect()} == {1: "unsafe-archive-path", 2: None, 3: "invalid-archive-entry", 4: None}


def test_credentials(spark):
    made = {"openai": "s" + "k-" + "a1" * 12, "google": "AI" + "za" + "B" * 35, "fine": "github" + "_pat_" + "a" * 40}
    docs = spark.createDataFrame([(i, f"x {v} y") for i, v in enumerate(made.values())] + [(9, "sk-short")], "doc_id long, text string")
    assert sorted(r["rule"] for r in validate.scan_credentials(docs).collect()) == ["github-fine-grained", "google", "sk"]


def test_search_tiers(spark):
    items = spark.createDataFrame([(1, "Crop", "cut", ["x"], "c", "k"), (2, "crop image", "", [], "c", "k"), (3, "x crop", "", [], "c", "k"), (4, "y", "", ["crops"], "c", "k"), (5, "z", "a crop", [], "c", "k")], "pos int, name string, description string, tags array<string>, category string, kind string")
    assert [(r["pos"], r["tier"]) for r in names.search(items, " CROP ", 9).orderBy("rank").collect()] == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    assert names.search(items, "  ").collect() == []


def test_free_numbers_of_a_root():
    """The smallest free number, as by trying each; numbers given in any order leave runs, not names, as state."""
    rng = random.Random(6)
    for _ in range(300):
        taken, used = names.Taken(), set()
        for _ in range(60):
            stem = "x" + "".join(rng.choice(["", "", "-2", "-3", "-4", "-12", "-02", "-1", "-0"]) for _ in range(2))
            n, name = 2, stem
            while name in used:
                name, n = f"{stem}-{n}", n + 1
            used.add(name)
            assert stem + taken.take(stem) == name
    taken, numbers = names.Taken(), list(range(2, 100_002))
    rng.shuffle(numbers)
    assert all(taken.take(f"r-{n}") == "" for n in numbers)
    assert taken.runs == {"r": ([2], [100_001])} and taken.take("r") == "" and taken.take("r") == "-100002" and taken.take("r-7") == "-2"


def test_edits_of_long_sides_are_the_fewest():
    rng = random.Random(4)

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    def check(a, b):
        edits = [(k, i + n if i >= 0 else -1, j + n if j >= 0 else -1) for k, i, j, size in compare.shortest_edits(a, b) for n in range(size)]
        assert [i for k, i, _ in edits if k != 2] == list(range(len(a))) and [j for k, _, j in edits if k != 1] == list(range(len(b)))
        assert all(a[i] == b[j] for k, i, j in edits if k == 0)
        assert sum(k != 0 for k, _, _ in edits) == len(a) + len(b) - 2 * common(a, b)

    a = [str(rng.randrange(400)) for _ in range(2100)]
    b = [x for x in a if rng.random() > 0.2]
    b += [str(rng.randrange(400)) for _ in range(2100 - len(b))]
    check(a, b)
    check(*([rng.choice("abcd") for _ in range(3000)] for _ in range(2)))
    for _ in range(300):
        check(*([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2)))


def test_unlike_texts_of_many_lines_are_compared_at_once():
    """8,000 lines against 8,000 others, few of them alike; rows made again from the kept ones say the same."""
    rng = random.Random(8)
    a, b = ([str(rng.randrange(8000)) for _ in range(8000)] for _ in range(2))
    began = time.process_time()
    edits = compare.shortest_edits(a, b)
    assert time.process_time() - began < 5
    assert sum(n for k, *_, n in edits if k != 1) == sum(n for k, *_, n in edits if k != 2) == 8000
    codes = [[int(x) for x in side] for side in (a[:300], b[:300])]
    table = compare.SuffixTable(*([x for x in side if x in other] for side, other in (codes, codes[::-1])), cached_bytes=0)
    rows = {len(table.a): table.full}
    for i in range(len(table.a) - 1, -1, -1):
        rows[i] = table.above(rows[i + 1], table.a[i])
    assert all(int.from_bytes(table.row(i), "little") == rows[i] for i in range(len(table.a)))


def test_a_comparison_beyond_its_budget_has_a_code(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc"), (2, "c\nb\na"), (3, "a\nb\nc\nd"), (4, None)], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 1, 2), (2, 1, 3), (3, 1, 1), (4, 4, 1), (5, 4, 9)], "pair_id long, left_id long, right_id long")
    found = compare.diff_lines(pairs, docs, max_cells=8).orderBy("pair_id", "ord")
    rows = [tuple(r) for r in found.collect()]
    assert rows[0] == (1, None, None, None, None, None, "comparison-complexity-limit") and all(r[6] is None for r in rows[1:])
    assert [r[1:6] for r in rows if r[0] == 2] == [(k, "unchanged", k, k, "abc"[k - 1]) for k in (1, 2, 3)] + [(4, "added", None, 4, "d")]
    assert [r[1:6] for r in rows if r[0] == 4] == [(k, "added", None, k, "abc"[k - 1]) for k in (1, 2, 3)] and {r[0] for r in rows} == {1, 2, 3, 4}
    stats = {r["pair_id"]: r for r in compare.diff_stats(found).collect()}
    assert stats[1]["identical"] is None and stats[1]["added"] is None and stats[3]["identical"] and stats[2]["added"] == 1
    assert {r["pair_id"]: r["html"] is None for r in compare.diff_report_html(found).collect()}[1]
    whole = [tuple(r) for r in compare.diff_lines(pairs, docs).filter("pair_id = 1").orderBy("ord").collect()]
    assert [r[2:6] for r in whole] == [("added", None, 1, "c"), ("added", None, 2, "b"), ("unchanged", 1, 3, "a"), ("removed", 2, None, "b"), ("removed", 3, None, "c")]


def test_one_result_is_read_from_its_bucket(spark, tmp_path):
    rows = spark.range(500).selectExpr("'n' || id AS name", "'text ' || id AS text")
    files.write_result_buckets(rows, str(tmp_path / "out"), 8)
    found = files.read_result_buckets(spark, str(tmp_path / "out"), 8, "n77")
    assert [tuple(r) for r in found.collect()] == [("n77", "text 77")]
    assert "PartitionFilters: [isnotnull(bucket" in found._jdf.queryExecution().executedPlan().toString() and len(found.inputFiles()) >= 1
