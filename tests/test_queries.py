"""Every query with SQL against DuckDB, and invariants of those that SQL can't express."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quire.operators import names, pages
from quire.plans import assets, checks, text
from quire.plans import fixtures as fx
from quire.plans.catalog import QUERIES
from quire.plans.oracle import differences


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_rows_equal_sql(spark, sf_dir, name):
    query = QUERIES[name]
    assert differences(query.frame, query.oracle(), spark, sf_dir) == []


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_id", "summary", "n_sentences"]


def test_diff_rebuilds_both_sides_with_the_fewest_edits(spark, sf_dir):
    rows = {}
    for r in checks.diff(spark, sf_dir).collect():
        rows.setdefault(r["pair_id"], []).append(r)
    pairs, docs = fx.diff_inputs(spark, sf_dir)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    def lines(text):
        out = (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")
        return out[:-1] if out[-1] == "" else out

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    for p in pairs.collect():
        found = sorted(rows.get(p["pair_id"], []), key=lambda r: r["ord"])
        a, b = lines(texts.get(p["left_id"])), lines(texts.get(p["right_id"]))
        assert [r["ord"] for r in found] == list(range(1, len(found) + 1))
        assert [r["text"] for r in found if r["kind"] != "added"] == a and [r["text"] for r in found if r["kind"] != "removed"] == b
        assert [r["left_line"] for r in found if r["left_line"]] == list(range(1, len(a) + 1)) and [r["right_line"] for r in found if r["right_line"]] == list(range(1, len(b) + 1))
        assert sum(r["kind"] != "unchanged" for r in found) == len(a) + len(b) - 2 * common(a, b)
        assert not any(x["kind"] == "added" and y["kind"] == "removed" for x, y in zip(found, found[1:], strict=False))


def test_unique_names_equal_one_by_one(spark, sf_dir):
    jobs = {}
    for r in assets.results(spark, sf_dir).collect():
        jobs.setdefault(r["job_id"], []).append((r["seq"], r["name"]))
    found = {(r["job_id"], r["seq"]): r["name"] for r in names.unique_names(assets.results(spark, sf_dir)).collect()}
    for job, rows in jobs.items():
        used = set()
        for seq, name in sorted(rows):
            stem, dot, ext = name.rpartition(".")
            stem, suffix = (stem, f".{ext.lower()}") if dot else (name, "")
            new, n = f"{stem}{suffix}", 2
            while new.lower() in used:
                new, n = f"{stem}-{n}{suffix}", n + 1
            used.add(new.lower())
            assert found[job, seq] == new


def test_greedy_admission_one_by_one(spark, sf_dir):
    jobs = {}
    for r in checks.greedy(spark, sf_dir).collect():
        jobs.setdefault(r["job_id"], []).append(r)
    codes = set()
    for rows in jobs.values():
        n, total = 0, 0.0
        for r in sorted(rows, key=lambda r: r["seq"]):
            if r["error_code"] in (None, "too-many-files", "total-too-large"):
                code = "too-many-files" if n >= 50 else "total-too-large" if total + r["size"] > 20_000 else None
                assert r["error_code"] == code
                if code is None:
                    n, total = n + 1, total + r["size"]
            codes.add(r["error_code"])
            assert r["running_bytes"] == total
    assert "total-too-large" in codes


def test_stream_equals_batch(spark, sf_dir):
    order = ["job_id", "seq", "error_code", "accepted", "running_bytes"]
    batch = sorted(map(tuple, checks.greedy(spark, sf_dir).select(*order).collect()), key=str)
    stream = sorted(map(tuple, assets.admitted_stream(spark, sf_dir).select(*order).collect()), key=str)
    assert batch == stream
    markup = {r["page_id"]: r["text"] for r in text.html_pages(spark, sf_dir).collect()}
    for r in assets.extracted_stream(spark, sf_dir).collect():
        assert r["preview"] == markup[r["doc_id"]][:1600] and r["characters"] == len(markup[r["doc_id"]])


def test_admission_state_lasts_over_batches(spark, tmp_path):
    from quire.streaming.jobs import admit_stream

    schema = "job_id long, seq long, name string, size double"
    for i in range(3):
        spark.createDataFrame([(1, 2 * i, "a.pdf", 4.0), (1, 2 * i + 1, "b.pdf", 3.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = admit_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), max_total=11.0)
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sum(r["accepted"] for r in rows) == 3 and max(r["running_bytes"] for r in rows) == 11.0


def test_reflow_keeps_words_and_width(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in fx.docs(spark, sf_dir).collect()}
    lines = {}
    for r in QUERIES["c24_reflow"].frame(spark, sf_dir).collect():
        assert 0 < len(r["text"]) <= 60
        lines.setdefault(r["doc_id"], []).append((r["line"], r["text"]))
    for d, rows in lines.items():
        assert "".join("".join(t.split()) for _, t in sorted(rows)) == "".join(texts[d].split())


def test_html_leaves_no_markup(spark, sf_dir):
    rows = text.html_pages(spark, sf_dir).collect()
    assert all(r["text"] and "<div" not in r["text"] and "track(" not in r["text"] and "&amp;" not in r["text"] for r in rows)


def test_odd_characters_of_devanagari(spark, sf_dir):
    rows = checks.odd_characters(spark, sf_dir).collect()
    assert rows and all(r["code"] == f"U+{ord(r['character']):04X}" and 1 <= r["ord"] <= 5 for r in rows)


def test_extract_in_selection_order(spark):
    docs = spark.createDataFrame([(1, 5, "4-2")], "doc_id long, pages int, expr string")
    leaves = spark.createDataFrame([(1, p, f"t{p}") for p in range(1, 6)], "doc_id long, page int, text string")
    rows = pages.extract_pages(leaves, pages.select_pages(docs)).orderBy("output_page").collect()
    assert [r["text"] for r in rows] == ["t4", "t3", "t2"]
    assert pages.scope_pages(leaves, "page", 2).count() == 1
    assert leaves.filter(F.col("page") > 9).count() == 0
