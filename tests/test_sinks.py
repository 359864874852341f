"""Named files and streams: whole or nothing, once, and state that lasts."""

import os
import time

import pytest
from pyspark.sql import functions as F

from quire.operators import names, text
from quire.operators.validate import admit_files
from quire.sources import named
from quire.streaming import jobs

FILES = "job_id long, seq long, name string, size double"


def listed(path):
    return sorted(os.listdir(path)) if os.path.isdir(path) else []


def test_a_file_for_each_result(spark, tmp_path):
    """250 pages of three names give 250 files of the names that make them unique."""
    pages = spark.range(250).selectExpr("0L AS job_id", "id AS seq", "element_at(array('a b.html', 'é+%.html', 'c.html'), int(id % 3) + 1) AS name", "'text\\n' || id AS text")
    unique = names.unique_names(pages.select("job_id", "seq", "name")).select("seq", "name").join(pages.select("seq", "text"), "seq")
    named.write_named_results(unique, str(tmp_path / "out"))
    assert len(listed(tmp_path / "out")) == 250 and {"a b.html", "a b-84.html", "é+%.html", "c-83.html"} <= set(listed(tmp_path / "out"))
    found = {r["name"]: r["text"] for r in named.read_named_results(spark, str(tmp_path / "out")).collect()}
    assert found == {r["name"]: r["text"] for r in unique.collect()}
    with pytest.raises(Exception, match="there are files of these names: a b-10.html"):
        named.write_named_results(unique, str(tmp_path / "out"))
    named.write_named_results(unique.withColumn("text", F.lit(None).cast("string")).limit(3), f"file://{tmp_path}/out", replace=True)
    assert len(listed(tmp_path / "out")) == 250 and sum(os.path.getsize(tmp_path / "out" / n) == 0 for n in listed(tmp_path / "out")) == 3


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    rows = spark.range(0, 40, 1, 4).selectExpr("'n' || id AS name", "IF(id = 33, raise_error('broken'), 'x') AS text")
    with pytest.raises(Exception, match="broken"):
        named.write_named_results(rows, str(tmp_path / "out"))
    assert listed(tmp_path / "out") == []
    for bad in ("a/b", "", None, ".hidden", "_spark"):
        with pytest.raises(Exception, match="not a file name"):
            named.write_named_results(spark.createDataFrame([("good", "x"), (bad, "y")], "name string, text string"), str(tmp_path / "out"))
    with pytest.raises(ValueError, match="names that occur twice: n"):
        named.write_named_results(spark.createDataFrame([("n", "x"), ("n", "y")], "name string, text string"), str(tmp_path / "out"))
    assert listed(tmp_path / "out") == []
    named.write_named_results(spark.createDataFrame([], "name string, text string"), str(tmp_path / "out"))
    assert listed(tmp_path / "out") == []


def test_attempts_of_a_task_count_once(tmp_path):
    """Of two attempts the one that is reported is moved; the other's files go with the staging."""
    import pyarrow as pa

    (tmp_path / "_job").mkdir()
    writer = named.NamedFilesWriter(str(tmp_path), "_job", False)
    first, second = (writer.write(iter([pa.record_batch([["a", other], ["1", "2"]], ["name", "text"])])) for other in ("b", "c"))
    assert first.folder != second.folder
    writer.commit([first, None])
    named.clean(str(tmp_path), "_job")
    assert listed(tmp_path) == ["a", "b"]
    with pytest.raises(OSError):
        writer.write(iter([]))


def queue(spark, path, rows):
    spark.createDataFrame(rows, FILES).coalesce(1).write.mode("append").parquet(str(path))


def admitted(spark, tmp_path, **limits):
    source = spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = jobs.admit_stream(source, **limits).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))


def test_admission_over_batches_and_a_restart(spark, tmp_path):
    """Batches before and after a restart equal one pass over the whole."""
    rows = [(j, s, "a.pdf" if s % 5 else "b.txt", float((s * 7 + j) % 9)) for s in range(30) for j in (1, 2)]
    limits = {"suffixes": [".pdf"], "max_files": 14, "max_file": 7.0, "max_total": 50.0}
    queue(spark, tmp_path / "in", rows[:20])
    queue(spark, tmp_path / "in", rows[20:40])
    admitted(spark, tmp_path, **limits)
    queue(spark, tmp_path / "in", rows[40:])
    found = admitted(spark, tmp_path, **limits)
    assert found == sorted(map(tuple, admit_files(spark.createDataFrame(rows, FILES), **limits).collect()))
    assert {r[4] for r in found} >= {None, "too-many-files", "unsupported-type"}


def test_admission_goes_on_from_an_initial_state(spark, tmp_path):
    queue(spark, tmp_path / "in", [(1, 0, "a", 4.0), (2, 0, "a", 4.0), (3, 0, "a", 4.0)])
    before = spark.createDataFrame([(1, 2, 7.0), (2, 5, 1.0)], "job_id long, n long, total double")
    found = admitted(spark, tmp_path, max_files=5, max_total=10.0, initial=before)
    assert [r[4] for r in found] == ["total-too-large", "too-many-files", None] and [r[6] for r in found] == [7.0, 1.0, 4.0]


def test_a_job_is_forgotten_after_its_time(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    source = spark.readStream.schema(FILES).parquet(str(tmp_path / "in"))
    query = jobs.admit_stream(source, max_files=1, expire_ms=1).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").start()
    try:
        for seq in range(2):
            queue(spark, tmp_path / "in", [(1, seq, "a", 1.0)])
            end = time.time() + 40
            while time.time() < end and len(found := spark.read.schema(jobs.ADMITTED).parquet(str(tmp_path / "out")).collect()) <= seq:
                time.sleep(0.5)
    finally:
        query.stop()
    assert [r["accepted"] for r in found] == [True, True]


def test_a_job_of_many_files_in_one_batch(spark, tmp_path):
    """More rows than an Arrow batch holds, out of order, are taken by seq."""
    n = 60_000
    spark.range(n).selectExpr("1L AS job_id", f"(id * 7919) % {n} AS seq", "'f' AS name", "1.0D AS size").coalesce(1).write.parquet(str(tmp_path / "in"))
    found = admitted(spark, tmp_path, max_total=50_000.0)
    assert len(found) == n and all(r[5] == (r[1] < 50_000) and r[6] == min(r[1] + 1, 50_000) for r in found)


def test_jobs_of_a_bucket_are_told_apart(spark, tmp_path, monkeypatch):
    """Jobs that share a call have their own state over batches: ids that no double holds, and files without a job."""
    monkeypatch.setattr(jobs, "BUCKETS", 2)
    ids = [*range(40), 2**60, 2**60 + 1, -1, None]
    rows = [(j, s, "a.pdf" if s % 5 else "b.txt", float((s * 7 + k) % 9)) for s in range(12) for k, j in enumerate(ids)]
    limits = {"suffixes": [".pdf"], "max_files": 6, "max_file": 7.0, "max_total": 20.0}
    queue(spark, tmp_path / "in", rows[: 5 * len(ids)])
    time.sleep(1.1)
    queue(spark, tmp_path / "in", rows[5 * len(ids) :])
    source = spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = jobs.admit_stream(source, **limits).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    found = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    assert found == sorted(map(tuple, admit_files(spark.createDataFrame(rows, FILES), **limits).collect()), key=str)


def test_many_jobs_leave_in_few_frames():
    """3,000 jobs of a bucket are one call that yields by rows, not by jobs; a job's decisions go on over its parts."""
    import pandas as pd

    class State(dict):
        getValue, updateValue = dict.get, dict.__setitem__

    class Handle:
        def getMapState(self, *_):
            return State()

    admission = jobs.Admission(4, 12.0, None)
    admission.init(Handle())
    admission.handleInitialState((0,), pd.DataFrame({"job": ["7", "8"], "n": [3, 0], "total": [1.0, 11.5]}), None)
    rows = pd.DataFrame([(0, str(j), s, "f", 1.0 + s, None) for s in reversed(range(5)) for j in range(3000)], columns=["bucket", "job", "seq", "name", "size", "code"])
    frames = list(admission.handleInputRows((0,), iter([rows[:7000], rows[7000:]]), None))
    assert len(frames) == 2
    found = pd.concat(frames)
    for job, n, total in (("5", 4, 10.0), ("7", 4, 2.0), ("8", 0, 11.5)):
        its = found[found["job"] == job]
        assert its["seq"].tolist() == list(range(5)) and its["running_bytes"].iloc[-1] == total and admission.totals[(job,)] == (n, total)
    assert found["accepted"].sum() == 4 * 2998 + 1


def test_results_of_a_stream_are_written_once(spark, tmp_path, monkeypatch):
    """A run that breaks between the files and their mark, or before the batch's end, ends the same after another."""
    pages = [(i, f"<p>page {i}</p>") for i in range(6)]
    for part in (pages[:3], pages[3:]):
        spark.createDataFrame(part, "page_id long, html string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema("page_id long, html string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        jobs.write_results_stream(jobs.extract_results(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()

    write, calls = jobs.write_named_results, []

    def breaks(batch, path, replace):
        calls.append(path)
        if len(calls) == 2:
            write(batch.limit(1), path, replace=replace)
            raise RuntimeError("lost")
        write(batch, path, replace=replace)

    monkeypatch.setattr(jobs, "write_named_results", breaks)
    with pytest.raises(Exception, match="lost"):
        run()
    assert len(listed(tmp_path / "out")) == 4
    run()
    assert listed(tmp_path / "out") == [f"page-{i}.txt" for i in range(6)] and len(calls) == 3
    plain = {r["page_id"]: r["text"] for r in text.html_to_text(spark.createDataFrame(pages, "page_id long, html string")).collect()}
    assert {r["name"]: r["text"] for r in named.read_named_results(spark, str(tmp_path / "out")).collect()} == {f"page-{i}.txt": t for i, t in plain.items()}
    run()
    assert len(calls) == 3


def test_results_are_worked_out_once_and_moved_by_tasks(spark, tmp_path, monkeypatch):
    """A stream's texts are made once a row, not again for the check of names; the driver lists and moves no result."""
    spark.range(40).selectExpr("id AS page_id", "'t' || id AS html").coalesce(1).write.parquet(str(tmp_path / "in"))
    made = spark.sparkContext.accumulator(0)

    def text(html):
        made.add(1)
        return html

    monkeypatch.setattr(named.NamedFilesWriter, "commit", lambda *_: pytest.fail("moved by the driver"))
    stream = spark.readStream.schema("page_id long, html string").parquet(str(tmp_path / "in"))
    jobs.write_results_stream(stream.select(F.format_string("n%d", "page_id").alias("name"), F.udf(text)("html").alias("text")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert made.value == 40 and listed(tmp_path / "out") == sorted(f"n{i}" for i in range(40))


def test_a_repeated_move_changes_nothing(tmp_path):
    import pyarrow as pa

    (tmp_path / "_job").mkdir()
    (tmp_path / "_job" / "a").write_text("1")
    batch = pa.record_batch([[str(tmp_path / "_job")] * 1, ["a"]], ["folder", "name"])
    for _ in range(2):
        assert [b["n"].to_pylist() for b in named.moved(str(tmp_path), iter([batch]))] == [[1]]
    assert (tmp_path / "a").read_text() == "1" and listed(tmp_path / "_job") == []
    with pytest.raises(OSError):
        list(named.moved(str(tmp_path), iter([pa.record_batch([[str(tmp_path / "_job")], ["b"]], ["folder", "name"])])))


def test_pages_of_one_row_group_are_dealt_to_all_tasks(spark, tmp_path):
    from quire.plans import assets

    spark.range(8 * assets.PAGES_A_FILE).selectExpr("id AS page_id", "'<p>' || id || '</p>' AS html").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    stream = assets.page_stream(spark, str(tmp_path))
    seen = []
    query = stream.writeStream.foreachBatch(lambda batch, _: seen.append(batch.select(F.input_file_name()).distinct().count())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert seen[0] >= spark.sparkContext.defaultParallelism


def test_text_results_move_by_folders(spark, tmp_path, monkeypatch):
    """A move a task and none a result; names that no file can have come back, and the inventory finds each."""
    from quire.sources import files

    rows = [("a/b", "x\n"), ("100%2F", ""), ("é+ %.html", "y\r\nz"), (".hidden", "h"), ("n\nm", "t")] + [(f"n{i}", str(i)) for i in range(200)]
    files.write_text_results(spark.createDataFrame(rows, "name string, text string").repartition(3), str(tmp_path / "out"))
    assert len(listed(tmp_path / "out")) == 3
    assert sorted(map(tuple, files.read_text_results(spark, f"file://{tmp_path}/out").collect())) == sorted(rows)
    found = files.file_inventory(spark, str(tmp_path)).collect()
    assert sorted(r["size"] for r in found) == sorted(len(t.encode()) + 1 for _, t in rows) and {r["extension"] for r in found} == {"txt"}
    assert all(r["path"].startswith(f"file:{tmp_path}/out/part-") for r in found)
