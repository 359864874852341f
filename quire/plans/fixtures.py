"""Inputs of the operators, derived from the given tables; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import joined
from quire.operators.text import logical_lines, split_lines

PAGE_LINES = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


LINES = r"""lines AS (SELECT doc_id, generate_subscripts(a, 1) AS line, unnest(a) AS text
  FROM (SELECT doc_id, string_split(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n$', ''), chr(10)) AS a FROM documents WHERE length(text) > 0))"""


def lines(spark, sf):
    return logical_lines(docs(spark, sf))


DOC_PAGES = LINES + f""",
doc_pages AS (SELECT doc_id, (line - 1) // {PAGE_LINES} + 1 AS page, string_agg(text, chr(10) ORDER BY line) AS text FROM lines GROUP BY 1, 2)"""


def doc_pages(spark, sf):
    """Documents as pages of four lines."""
    page = F.floor((F.col("line") - 1) / PAGE_LINES).cast("int") + 1
    return lines(spark, sf).groupBy("doc_id", page.alias("page")).agg(joined(F.collect_list(F.struct("line", "text")), "text", "\n").alias("text"))


# A page expression of every kind, by doc_id.
EXPRESSIONS = ("1-3, 6, 8-7, 2", "", "ALL", "3-1,2", "x,99,2-", "2,2,1", "0", "1,,2")
EXPR_SQL = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(EXPRESSIONS)) + " END"
DOC_COUNTS = DOC_PAGES + f""",
doc_counts AS (SELECT doc_id, max(page) AS pages, {EXPR_SQL} AS expr FROM doc_pages GROUP BY 1)"""


def doc_counts(spark, sf):
    counts = lines(spark, sf).groupBy("doc_id").agg(F.max(F.floor((F.col("line") - 1) / PAGE_LINES) + 1).cast("int").alias("pages"))
    return counts.withColumn("expr", F.expr(EXPR_SQL))


def selection(spark, sf):
    from quire.operators.pages import select_pages

    return select_pages(doc_counts(spark, sf))


SELECTION = DOC_COUNTS + r""",
parts AS (SELECT doc_id, pages, unnest(string_split(lower(trim(expr)), ',')) AS part, generate_subscripts(string_split(lower(trim(expr)), ','), 1) AS k FROM doc_counts),
ranges AS (SELECT doc_id, k, pages, trim(part) AS part,
    least(pages, greatest(1, coalesce(nullif(try_cast(regexp_extract(split_part(trim(part), '-', 1), '^\s*([+-]?[0-9]{1,9})', 1) AS INTEGER), 0), 1))) AS a,
    greatest(1, least(pages, coalesce(nullif(try_cast(regexp_extract(split_part(trim(part), '-', 2), '^\s*([+-]?[0-9]{1,9})', 1) AS INTEGER), 0), pages))) AS b,
    try_cast(regexp_extract(trim(part), '^\s*([+-]?[0-9]{1,9})', 1) AS INTEGER) AS one FROM parts),
expanded AS (SELECT doc_id, k, unnest(CASE WHEN part IN ('', 'all') AND (SELECT count(*) FROM parts p WHERE p.doc_id = ranges.doc_id) = 1 THEN generate_series(1, pages) WHEN contains(part, '-') AND a <= b THEN generate_series(a, b) WHEN contains(part, '-') THEN generate_series(a, b, -1) WHEN one BETWEEN 1 AND pages THEN [CAST(one AS BIGINT)] ELSE [] END) AS page,
    generate_subscripts(CASE WHEN part IN ('', 'all') AND (SELECT count(*) FROM parts p WHERE p.doc_id = ranges.doc_id) = 1 THEN generate_series(1, pages) WHEN contains(part, '-') AND a <= b THEN generate_series(a, b) WHEN contains(part, '-') THEN generate_series(a, b, -1) WHEN one BETWEEN 1 AND pages THEN [CAST(one AS BIGINT)] ELSE [] END, 1) AS j FROM ranges),
raw_selection AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) AS pos FROM expanded),
firsts AS (SELECT doc_id, page, min(pos) AS pos FROM raw_selection GROUP BY 1, 2),
selection AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos FROM firsts)"""


JOB_FILES = """jobs_files AS (SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
  event_type || '-' || CAST(event_id % 7 AS VARCHAR) || CASE event_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' WHEN 2 THEN '.png' WHEN 3 THEN '.docx' ELSE '' END AS name,
  CASE WHEN event_id % 11 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 13 = 0 THEN 0.0 WHEN event_id % 17 = 0 THEN -1.0 ELSE floor(value * 100) END AS size FROM events)"""


def jobs_files(spark, sf):
    ext = "CASE event_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' WHEN 2 THEN '.png' WHEN 3 THEN '.docx' ELSE '' END"
    size = "CASE WHEN event_id % 11 = 0 THEN double('NaN') WHEN event_id % 13 = 0 THEN 0D WHEN event_id % 17 = 0 THEN -1D ELSE double(floor(value * 100)) END"
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf, "events").select(F.col("user_id").alias("job_id"), seq.alias("seq"), F.expr(f"event_type || '-' || string(event_id % 7) || {ext}").alias("name"), F.expr(size).alias("size"))


IMAGE_META = """image_meta AS (SELECT p_partkey AS image_id, p_brand AS batch_id, 40 * p_size AS width, CAST(floor(p_retailprice) AS BIGINT) AS height FROM part)"""


def image_meta(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey AS image_id", "p_brand AS batch_id", "40 * p_size AS width", "bigint(floor(p_retailprice)) AS height")


_LEVEL = "greatest(0, least(255, CAST(floor((CAST(embedding[{i}] AS DOUBLE) * 3 + 1) / 2 * 255 + 0.5) AS BIGINT)))"
PIXELS = f"""cellno AS (SELECT unnest(generate_series(0, 63)) AS i),
pixels AS (SELECT vec_id AS image_id, i % 8 AS x, i // 8 AS y, {_LEVEL.format(i="i + 1")} AS r, {_LEVEL.format(i="(i + 1) % 64 + 1")} AS g, {_LEVEL.format(i="(i + 2) % 64 + 1")} AS b, 255 AS a FROM embeddings, cellno)"""


def pixels(spark, sf):
    """Vectors as images of 8 by 8."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    level = lambda at: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.get("embedding", at).cast("double") * 3 + 1) / 2 * 255 + 0.5)))
    i = F.col("i")
    return rows.select("image_id", (i % 8).alias("x"), F.floor(i / 8).cast("int").alias("y"), level(i).alias("r"), level((i + 1) % 64).alias("g"), level((i + 2) % 64).alias("b"), F.lit(255).cast("long").alias("a"))


PAIRS = r"""changed AS (SELECT doc_id, string_agg(CASE WHEN line % 7 = 0 THEN 'changed ' || text ELSE text END, chr(10) ORDER BY line) AS text FROM lines WHERE line % 11 <> 0 GROUP BY 1)"""


SPLIT = r"CASE WHEN length({0}) > 0 THEN string_split(regexp_replace(replace(replace({0}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n$', ''), chr(10)) ELSE [] END"
#: The edit scripts of ``diff_inputs`` by the rule of ``compare.shortest_edits``: the table of suffixes row by row, then the path through it.
SCRIPT = (
    "RECURSIVE "
    + LINES
    + ",\n"
    + PAIRS
    + f""",
sides AS (SELECT doc_id * 2 AS pair_id, {SPLIT.format("text")} AS a, {SPLIT.format("text")} AS b FROM documents
  UNION ALL SELECT d.doc_id * 2 + 1, {SPLIT.format("d.text")}, {SPLIT.format("coalesce(c.text, '')")} FROM documents d LEFT JOIN changed c USING (doc_id)),
heads AS (SELECT *, coalesce(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])[1] - 1, least(len(a), len(b))) AS h FROM sides),
tails AS (SELECT *, coalesce(list_filter(range(0, least(len(a), len(b)) - h), lambda i: a[len(a) - i] <> b[len(b) - i])[1], least(len(a), len(b)) - h) AS t FROM heads),
left_lines AS (SELECT pair_id, unnest(range(1, len(a) + 1)) AS line, unnest(a) AS text, h, len(a) - t AS last FROM tails),
right_lines AS (SELECT pair_id, unnest(range(1, len(b) + 1)) AS line, unnest(b) AS text, h, len(b) - t AS last FROM tails),
la AS (SELECT l.pair_id, row_number() OVER (PARTITION BY l.pair_id ORDER BY line) AS i, line, text FROM left_lines l WHERE line > h AND line <= last AND EXISTS (SELECT 1 FROM right_lines r WHERE r.pair_id = l.pair_id AND r.text = l.text AND r.line > r.h AND r.line <= r.last)),
rb AS (SELECT r.pair_id, row_number() OVER (PARTITION BY r.pair_id ORDER BY line) AS j, line, text FROM right_lines r WHERE line > h AND line <= last AND EXISTS (SELECT 1 FROM left_lines l WHERE l.pair_id = r.pair_id AND l.text = r.text AND l.line > l.h AND l.line <= l.last)),
sizes AS (SELECT pair_id, n, m FROM (SELECT pair_id, max(i) AS n FROM la GROUP BY 1) JOIN (SELECT pair_id, max(j) AS m FROM rb GROUP BY 1) USING (pair_id)),
table_rows(pair_id, i, j, v) AS (SELECT pair_id, n + 1, unnest(range(1, m + 2)), 0::BIGINT FROM sizes
  UNION ALL SELECT pair_id, i - 1, j, max(c) OVER (PARTITION BY pair_id ORDER BY j DESC) FROM (
    SELECT t.pair_id, t.i, t.j, CASE WHEN la.text = rb.text THEN t.w + 1 ELSE t.v END AS c FROM (SELECT *, lead(v) OVER (PARTITION BY pair_id ORDER BY j) AS w FROM table_rows) t
    JOIN la ON la.pair_id = t.pair_id AND la.i = t.i - 1 LEFT JOIN rb ON rb.pair_id = t.pair_id AND rb.j = t.j)),
steps AS (SELECT t.pair_id, t.i, t.j, la.line AS left_line, rb.line AS right_line, CASE WHEN la.text = rb.text THEN 0 WHEN t.v = u.v THEN 1 ELSE 2 END AS move
  FROM table_rows t JOIN la ON la.pair_id = t.pair_id AND la.i = t.i JOIN rb ON rb.pair_id = t.pair_id AND rb.j = t.j JOIN table_rows u ON u.pair_id = t.pair_id AND u.i = t.i AND u.j = t.j + 1),
path(pair_id, i, j, left_line, right_line, move) AS (SELECT * FROM steps WHERE i = 1 AND j = 1
  UNION ALL SELECT s.pair_id, s.i, s.j, s.left_line, s.right_line, s.move FROM path p JOIN steps s ON s.pair_id = p.pair_id AND s.i = p.i + CASE WHEN p.move = 1 THEN 0 ELSE 1 END AND s.j = p.j + CASE WHEN p.move = 2 THEN 0 ELSE 1 END),
matches AS (SELECT pair_id, left_line, right_line, row_number() OVER (PARTITION BY pair_id ORDER BY left_line) AS block FROM (SELECT pair_id, left_line, right_line FROM path WHERE move = 0
  UNION ALL SELECT pair_id, unnest(range(1, h + 1)), unnest(range(1, h + 1)) FROM tails UNION ALL SELECT pair_id, unnest(range(len(a) - t + 1, len(a) + 1)), unnest(range(len(b) - t + 1, len(b) + 1)) FROM tails)),
placed_left AS (SELECT l.pair_id, l.line, l.text, m.right_line, m.left_line IS NOT NULL AS kept, coalesce(max(m.block) OVER (PARTITION BY l.pair_id ORDER BY l.line), 0) AS block FROM left_lines l LEFT JOIN matches m ON m.pair_id = l.pair_id AND m.left_line = l.line),
placed_right AS (SELECT r.pair_id, r.line, r.text, m.right_line IS NOT NULL AS kept, coalesce(max(m.block) OVER (PARTITION BY r.pair_id ORDER BY r.line), 0) AS block FROM right_lines r LEFT JOIN matches m ON m.pair_id = r.pair_id AND m.right_line = r.line),
script AS (SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY block, k, line) AS ord, kind, left_line, right_line, text FROM (
  SELECT pair_id, block, 0 AS k, line, 'unchanged' AS kind, line AS left_line, right_line, text FROM placed_left WHERE kept
  UNION ALL SELECT pair_id, block, 1, line, 'removed', line, NULL, text FROM placed_left WHERE NOT kept
  UNION ALL SELECT pair_id, block, 2, line, 'added', NULL, line, text FROM placed_right WHERE NOT kept))"""
)


def diff_inputs(spark, sf):
    """Each document with itself, and with a copy of which every 7th line is changed and every 11th dropped."""
    own = docs(spark, sf)
    rows = F.transform(split_lines(F.col("text")), lambda x, i: F.when((i + 1) % 11 != 0, F.when((i + 1) % 7 == 0, F.concat(F.lit("changed "), x)).otherwise(x)))
    changed = own.filter("length(text) > 0").select("doc_id", F.array_join(F.filter(rows, lambda x: x.isNotNull()), "\n").alias("text"))
    both = own.select((F.col("doc_id") * 2).alias("doc_id"), "text").unionByName(changed.select((F.col("doc_id") * 2 + 1).alias("doc_id"), "text"))
    pairs = own.select((F.col("doc_id") * 2).alias("pair_id"), (F.col("doc_id") * 2).alias("left_id"), (F.col("doc_id") * 2).alias("right_id")).unionByName(own.select((F.col("doc_id") * 2 + 1).alias("pair_id"), (F.col("doc_id") * 2).alias("left_id"), (F.col("doc_id") * 2 + 1).alias("right_id")))
    return pairs, both


NUMBERED = LINES + r""",
nl AS (SELECT doc_id, line, line || ': ' || text AS t, line % 11 = 0 AS gone, line % 7 = 0 AS alt FROM lines),
nr AS (SELECT *, CASE WHEN NOT gone THEN row_number() OVER (PARTITION BY doc_id, gone ORDER BY line) END AS rl FROM nl),
nb AS (SELECT *, sum(CASE WHEN gone OR alt THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line) AS blk FROM nr),
nk AS (SELECT doc_id, blk, 0 AS k, line, 'unchanged' AS kind, line AS left_line, rl AS right_line, t AS text FROM nb WHERE NOT (gone OR alt)
  UNION ALL SELECT doc_id, blk, 1, line, 'removed', line, NULL, t FROM nb WHERE gone OR alt
  UNION ALL SELECT doc_id, blk, 2, line, 'added', NULL, rl, 'changed ' || t FROM nb WHERE alt AND NOT gone),
numbered AS (SELECT doc_id AS pair_id, row_number() OVER (PARTITION BY doc_id ORDER BY blk, k, line) AS ord, kind, left_line, right_line, text FROM nk)"""


def numbered_diff_inputs(spark, sf):
    """As ``diff_inputs``, but with numbered lines: no two are alike, so there is one shortest edit script."""
    own = lines(spark, sf).withColumn("text", F.concat(F.col("line").cast("string"), F.lit(": "), "text"))
    side = lambda rows, doc: rows.groupBy("doc_id").agg(joined(F.collect_list(F.struct("line", "text")), "text", "\n").alias("text")).select(doc.alias("doc_id"), "text")
    changed = own.filter("line % 11 <> 0").withColumn("text", F.expr("CASE WHEN line % 7 = 0 THEN 'changed ' || text ELSE text END"))
    key = F.col("doc_id")
    pairs = own.select("doc_id").distinct().select(key.alias("pair_id"), (key * 2).alias("left_id"), (key * 2 + 1).alias("right_id"))
    return pairs, side(own, key * 2).unionByName(side(changed, key * 2 + 1))


CELLS = """cells AS (SELECT c_nationkey AS doc_id, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 WHEN 'MACHINERY' THEN 4 ELSE 5 END AS sheet_no, c_mktsegment AS sheet,
   row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS r0, c_custkey, c_name, c_acctbal FROM customer),
cell_rows AS (SELECT doc_id, sheet_no, sheet, r0 + 1 AS row, 1 AS col, c_name AS value FROM cells
   UNION ALL SELECT doc_id, sheet_no, sheet, r0 + 1, 3, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END FROM cells WHERE c_custkey % 3 <> 0)"""


def cells(spark, sf):
    """Customers as a workbook a nation and a sheet a segment, with gaps."""
    w = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")
    number = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 WHEN 'MACHINERY' THEN 4 ELSE 5 END"
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("doc_id"), F.expr(number).alias("sheet_no"), F.col("c_mktsegment").alias("sheet"), (F.row_number().over(w) + 1).alias("row"), "c_custkey", "c_name")
    first = rows.select("doc_id", "sheet_no", "sheet", "row", F.lit(1).alias("col"), F.col("c_name").alias("value"))
    third = rows.filter("c_custkey % 3 <> 0").select("doc_id", "sheet_no", "sheet", "row", F.lit(3).alias("col"), F.expr("CASE WHEN c_custkey % 4 = 0 THEN '' ELSE string(c_custkey) END").alias("value"))
    return first.unionByName(third)
