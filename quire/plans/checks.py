"""Queries over admission, budgets, audits, forms and regions (operators B and R)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import compare, forms, text, validate
from quire.plans import fixtures as fx
from quire.plans.registry import Query
from quire.shared import materialize

SUFFIXES = [".pdf", ".png"]
STATELESS = "CASE WHEN isnan(size) OR size < 0 THEN 'invalid-size' WHEN size = 0 THEN 'empty-file' WHEN NOT (ends_with(lower(name), '.pdf') OR ends_with(lower(name), '.png')) THEN 'unsupported-type' WHEN size > 9000 THEN 'file-too-large' END"
ADMITTED = fx.JOB_FILES + f""",
a1 AS (SELECT *, {STATELESS} AS code FROM jobs_files), a2 AS (SELECT *, sum(CASE WHEN code IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY seq) AS nth FROM a1),
admitted AS (SELECT job_id, seq, name, size, coalesce(code, CASE WHEN nth > 20 THEN 'too-many-files' END) AS error_code FROM a2)"""


def admitted(spark, sf):
    return validate.admit_files(fx.jobs_files(spark, sf), SUFFIXES, 20, 9000)


#: One file of each job a step, with the count and bytes so far.
GREEDY = f"""WITH RECURSIVE {fx.JOB_FILES},
g1 AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS k, {STATELESS} AS code FROM jobs_files),
g2 AS (SELECT DISTINCT job_id, CAST(NULL AS BIGINT) AS seq, '' AS name, CAST(0 AS BIGINT) AS k, 0 AS n, CAST(0 AS DOUBLE) AS total, '' AS error_code FROM g1
  UNION ALL SELECT g1.job_id, g1.seq, g1.name, g1.k, g2.n + CASE WHEN code IS NULL AND g2.n < 50 AND g2.total + g1.size <= 20000 THEN 1 ELSE 0 END,
    g2.total + CASE WHEN code IS NULL AND g2.n < 50 AND g2.total + g1.size <= 20000 THEN g1.size ELSE 0 END,
    coalesce(code, CASE WHEN g2.n >= 50 THEN 'too-many-files' WHEN g2.total + g1.size > 20000 THEN 'total-too-large' END)
  FROM g2 JOIN g1 ON g1.job_id = g2.job_id AND g1.k = g2.k + 1)
--
SELECT job_id, seq, name, error_code, error_code IS NULL AS accepted, total AS running_bytes FROM g2 WHERE k > 0"""


def greedy(spark, sf):
    return validate.admit_files(fx.jobs_files(spark, sf), SUFFIXES, 50, 9000, 20_000)


REASON = "CASE error_code " + " ".join(f"WHEN '{c}' THEN CASE WHEN n = 1 THEN '{a}' ELSE '{b}' END" for c, (a, b) in validate.REJECTION_TEXTS.items()) + " END"


def policies(spark, sf):
    """Limits of the tools that parts stand for: a profile for some types, defaults for the rest."""
    part = fx.table(spark, sf, "part")
    names = [*validate.ALIASES, *sorted(set(validate.ALIASES.values())), "merge-pdf"]
    slug = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names) + 1).cast("int"))
    tools = part.select(slug.alias("slug")).distinct()
    sizes = part.select(slug.alias("slug"), "p_size", "p_retailprice").groupBy("slug").agg(F.max("p_size").alias("a"), F.max("p_retailprice").alias("b"))
    profiles = sizes.filter("slug NOT LIKE '%image'").select("slug", F.inline(F.array(F.struct(F.lit("max_files").alias("limit"), F.col("a").cast("double").alias("value")), F.struct(F.lit("max_bytes").alias("limit"), F.col("b").alias("value")))))
    return validate.resolve_policy(tools, profiles, {"min_files": 1.0, "max_files": 1.0, "max_bytes": None})


NAMES = [*validate.ALIASES, *sorted(set(validate.ALIASES.values())), "merge-pdf"]
POLICIES = f"""WITH t AS (SELECT list_extract([{', '.join(f"'{n}'" for n in NAMES)}], CAST(p_partkey % {len(NAMES)} + 1 AS INTEGER)) AS slug, p_size, p_retailprice FROM part),
s AS (SELECT slug, max(p_size) AS a, max(p_retailprice) AS b FROM t GROUP BY 1), k AS (SELECT slug, CASE slug {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in validate.ALIASES.items())} ELSE slug END AS key FROM s)
--
SELECT k.slug, key, 1.0 AS min_files, coalesce(s.a, 1) AS max_files, s.b AS max_bytes FROM k LEFT JOIN s ON s.slug = k.key AND s.slug NOT LIKE '%image'"""


def jobs(spark, sf):
    return fx.table(spark, sf, "events").select(F.col("user_id").alias("job_id")).distinct().unionByName(fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("job_id"))).distinct().withColumn("min_files", (F.col("job_id") % 40).cast("int"))


def meta(spark, sf):
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax")
    return fx.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("job_id"), F.row_number().over(w).alias("seq"), F.col("l_quantity").cast("int").alias("pages"), (F.col("l_linenumber") * 100).cast("long").alias("width"), (F.col("l_quantity") * 10).cast("long").alias("height"))


META = "WITH m AS (SELECT l_suppkey AS job_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) AS seq, CAST(l_quantity AS BIGINT) AS pages, l_linenumber * 100 * CAST(l_quantity * 10 AS BIGINT) AS pixels FROM lineitem)"


def archives(spark, sf):
    entries = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.expr("CASE WHEN l_partkey % 97 = 0 THEN 'word/../../x' ELSE 'word/' || l_linenumber || '..xml' END").alias("name"), (F.col("l_extendedprice") * 10_000).alias("size"))
    files = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("file_id"), F.col("o_totalprice").alias("size"))
    policy = {"max_entries": 6, "max_item": 900_000_000, "max_total": 2_400_000_000, "ratio": 8000, "ratio_floor": 64 * validate.MIB}
    return validate.screen_archives(entries, files, policy)


ARCHIVES = """WITH f AS (SELECT l_orderkey AS file_id, count(*) AS n, sum(l_extendedprice * 10000) AS e, max(l_extendedprice * 10000) AS m, bool_or(l_partkey % 97 = 0) AS u FROM lineitem GROUP BY 1)
--
SELECT o_orderkey AS file_id, coalesce(n, 0) AS n_entries, coalesce(e, 0) AS expanded, CASE WHEN n > 6 THEN 'archive-entry-limit' WHEN u THEN 'unsafe-archive-path' WHEN m > 900000000 THEN 'archive-entry-too-large' WHEN e > 2400000000 THEN 'archive-expansion-limit' WHEN o_totalprice > 0 AND e > greatest(67108864, o_totalprice * 8000) THEN 'archive-ratio-limit' END AS error_code FROM orders LEFT JOIN f ON file_id = o_orderkey"""


def settings(spark, sf):
    part = fx.table(spark, sf, "part")
    options = part.select(F.col("p_partkey").alias("job_id"), F.lit("t").alias("tool"), F.col("p_type").alias("key"), F.expr("CASE WHEN p_partkey % 19 = 0 THEN 'many' ELSE string(p_size) END").alias("value"))
    ranges = part.groupBy(F.col("p_type").alias("key")).agg(F.min("p_partkey").alias("k")).filter("k % 3 <> 0").select(F.lit("t").alias("tool"), "key", F.lit(10.0).alias("low"), F.lit(40.0).alias("high"))
    return validate.check_settings(options, ranges)


def texts_of_turns(spark, sf):
    return fx.table(spark, sf, "conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("seq"), "text")


def odd_characters(spark, sf):
    return validate.unsupported_chars(text.apply_glossary(fx.docs(spark, sf), "hi").select("doc_id", F.col("body").alias("text")))


ODD_CHARACTERS = r"""WITH o1 AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+')) AS w, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), 1) AS k FROM documents),
o2 AS (SELECT doc_id, string_agg(coalesce(CASE lower(w) """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.GLOSSARIES["hi"].items()) + r""" END, w), '' ORDER BY k) AS body FROM o1 GROUP BY 1),
o3 AS (SELECT doc_id, unnest(regexp_extract_all(body, '(?s).')) AS c, generate_subscripts(regexp_extract_all(body, '(?s).'), 1) AS pos FROM o2),
o4 AS (SELECT doc_id, c, min(pos) AS pos FROM o3 WHERE NOT (unicode(c) IN (9, 10, 13) OR unicode(c) BETWEEN 32 AND 126 OR unicode(c) BETWEEN 160 AND 255) AND NOT contains('""" + validate.WIN_ANSI_EXTRA + r"""', c) GROUP BY 1, 2),
o5 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ord FROM o4)
--
SELECT doc_id, ord, c AS character, 'U+' || printf('%04X', unicode(c)) AS code FROM o5 WHERE ord <= 5"""


def with_credentials(spark, sf):
    """Documents with a line of each credential's form; built from pieces, so that no such text is kept here."""
    made = [("private-key", ["-----BEGIN ", "RSA PRIVATE KEY-----"]), ("github", ["ghp", "_", "Ab1" * 8]), ("npm", ["npm", "_", "Ab1" * 11]), ("aws", ["AK", "IA", "Q9" * 8]), ("slack", ["xox", "b-", "1a2b3c4d5e6f"]), ("url-password", ["http:/", "/user:pass", "word@host"])]
    line = F.element_at(F.array(*[F.lit("".join(p)) for _, p in made]), (F.col("doc_id") % len(made) + 1).cast("int"))
    return validate.scan_credentials(fx.docs(spark, sf).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n"), line, F.lit(" end"))).otherwise(F.col("text")).alias("text")))


def paths(spark, sf):
    """Paths of parts: ordinary, generated and credential-like ones, of sizes around the limits."""
    path = "CASE p_partkey % 8 WHEN 0 THEN 'src/' || p_brand || '.md' WHEN 1 THEN 'app/dist/' || p_partkey WHEN 2 THEN '.env' WHEN 3 THEN 'a/ID_RSA' WHEN 4 THEN 'conf/credentials.prod.json' WHEN 5 THEN 'keys/x' || p_partkey || '.PEM' WHEN 6 THEN 'distant/node_modules/x' ELSE 'docs/design-qa-1.png' END"
    return fx.table(spark, sf, "part").select(F.expr(path).alias("path"), (F.col("p_size").cast("long") * 3_000_000 + F.col("p_partkey")).alias("size"))


PATHS = """a AS (SELECT p_partkey % 8 AS k, CASE p_partkey % 8 WHEN 0 THEN 'src/' || p_brand || '.md' WHEN 1 THEN 'app/dist/' || p_partkey WHEN 2 THEN '.env' WHEN 3 THEN 'a/ID_RSA' WHEN 4 THEN 'conf/credentials.prod.json' WHEN 5 THEN 'keys/x' || p_partkey || '.PEM' WHEN 6 THEN 'distant/node_modules/x' ELSE 'docs/design-qa-1.png' END AS path, p_size * 3000000 + p_partkey AS size FROM part)"""


def links(spark, sf):
    pages = fx.table(spark, sf, "pages").withColumnRenamed("page_id", "doc_id")
    found = validate.link_targets(pages)
    return validate.check_links(found, found.filter("doc_id % 2 = 0"), ("rooted",))


def placements(spark, sf):
    """Parts placed on orders' pages; some assets, pages and ranges are wrong."""
    items = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("ord"), (F.col("l_partkey") % 5).alias("asset_id"), (F.col("l_linenumber") - 1).alias("page_index"), (F.col("l_discount") * 9).alias("x"), F.col("l_tax").alias("y"), (F.col("l_quantity") / 50).alias("width"), (F.col("l_quantity") * 4).alias("rotation"), (1 - F.col("l_tax")).alias("opacity"))
    orders = fx.table(spark, sf, "orders")
    assets = orders.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("asset_id"))
    return validate.check_placements(items, assets, orders.select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 7 + 1).alias("pages")))


PLACEMENTS = """SELECT l_orderkey AS doc_id, l_partkey AS ord, CASE WHEN l_partkey % 5 > 3 OR o_orderkey IS NULL THEN 'missing-overlay-image' WHEN l_linenumber - 1 > o_orderkey % 7 THEN 'invalid-overlay-page' WHEN l_discount * 9 > 1 OR l_tax > 1 OR l_quantity / 50 < 0.02 OR l_quantity / 50 > 1 OR l_discount * 9 + l_quantity / 50 > 1.000001 OR l_quantity * 4 > 180 OR 1 - l_tax < 0.1 THEN 'invalid-overlay-placement' END AS error_code FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey"""

SANITIZE = r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<[A-Za-z][^<>]*>')) AS tag FROM pages), n AS (SELECT page_id, tag, lower(regexp_extract(tag, '^<([A-Za-z][A-Za-z0-9:-]*)', 1)) AS name FROM t),
b AS (SELECT *, regexp_matches(name, '^(?:""" + validate.BLOCKED + r""")$') AS blocked FROM n),
p AS (SELECT page_id, name, unnest(regexp_extract_all(tag, '\s([A-Za-z][A-Za-z0-9:_-]*\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+))', 1)) AS pair FROM b WHERE NOT blocked),
a AS (SELECT page_id, name, lower(regexp_extract(pair, '^[^\s=]+')) AS a, trim(regexp_replace(regexp_extract(pair, '(?s)=\s*(.*)$', 1), '^["'']|["'']$', '', 'g')) AS v FROM p),
g AS (SELECT *, regexp_matches(v, '(?i)url\s*\(\s*["'']?\s*[^#"''\s)]') AS url, a = 'src' AND name = 'img' AND regexp_matches(v, '(?i)^data:image/(?:gif|jpe?g|png|webp);base64,[a-z0-9+/]+={0,2}$') AS kept FROM a),
h AS (SELECT *, starts_with(a, 'on') OR a IN ('class', 'contenteditable', 'id', 'style', 'xml:base') OR CASE WHEN a = 'src' THEN NOT kept ELSE a IN ('action', 'background', 'formaction', 'href', 'ping', 'poster', 'srcset', 'xlink:href') OR url END AS goes FROM g),
c AS (SELECT page_id, count(*) FILTER (WHERE goes) AS ra, count(*) FILTER (WHERE goes AND (url OR a IN ('src', 'action', 'background', 'formaction', 'href', 'ping', 'poster', 'srcset', 'xlink:href'))) AS rr, count(*) FILTER (WHERE kept) AS k FROM h GROUP BY 1),
e AS (SELECT page_id, count(*) FILTER (WHERE blocked) AS re FROM b GROUP BY 1)
--
SELECT page_id, coalesce(re, 0) AS removed_elements, coalesce(ra, 0) AS removed_attributes, coalesce(rr, 0) AS removed_resources, coalesce(k, 0) AS kept_images FROM pages LEFT JOIN e USING (page_id) LEFT JOIN c USING (page_id)"""

DIFF_COLUMNS = "pair_id:l ord:l kind:s left_line:l right_line:l text:s"


def diff(spark, sf):
    return compare.diff_lines(*fx.diff_inputs(spark, sf))


def numbered_diff(spark, sf):
    return compare.diff_lines(*fx.numbered_diff_inputs(spark, sf))


def identical_diff(spark, sf):
    pairs, docs = fx.diff_inputs(spark, sf)
    return compare.diff_lines(pairs.filter("left_id = right_id"), docs)


def event_values(spark, sf):
    """Form values of every kind, made around the events' properties."""
    value = "CASE event_id % 9 WHEN 0 THEN props WHEN 1 THEN '{\"name\": \"' || event_type || '\", \"ok\": true, \"gone\": null}' WHEN 2 THEN '[1]' WHEN 3 THEN '{bad' WHEN 4 THEN '{\"\": \"x\"}' WHEN 5 THEN '{\"list\": [\"a\", \"b\"], \"name\": \"' || user_id || '\"}' WHEN 6 THEN '' WHEN 7 THEN '{\"ok\": \"yes\", \"list\": \"z\"}' ELSE '{\"name\": {\"x\": 1}}' END"
    return fx.table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.expr(value).alias("values"))


KINDS = """WITH v AS (SELECT event_id AS doc_id, event_id % 9 AS m, event_type, user_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events)
--
SELECT doc_id, 'k' AS name, NULL AS kind, k AS value_json, 'unsupported-form-value' AS error_code FROM v WHERE m = 0
UNION ALL SELECT doc_id, 'name', 'text', '"' || event_type || '"', NULL FROM v WHERE m = 1 UNION ALL SELECT doc_id, 'ok', 'boolean', 'true', NULL FROM v WHERE m = 1 UNION ALL SELECT doc_id, 'gone', 'null', 'null', NULL FROM v WHERE m = 1
UNION ALL SELECT doc_id, NULL, NULL, NULL, 'invalid-form-values' FROM v WHERE m IN (2, 3) UNION ALL SELECT doc_id, '', 'text', '"x"', 'empty-field-name' FROM v WHERE m = 4
UNION ALL SELECT doc_id, 'list', 'list', '["a","b"]', NULL FROM v WHERE m = 5 UNION ALL SELECT doc_id, 'name', 'text', '"' || user_id || '"', NULL FROM v WHERE m = 5
UNION ALL SELECT doc_id, 'ok', 'text', '"yes"', NULL FROM v WHERE m = 7 UNION ALL SELECT doc_id, 'list', 'text', '"z"', NULL FROM v WHERE m = 7 UNION ALL SELECT doc_id, 'name', NULL, '{"x":1}', 'unsupported-form-value' FROM v WHERE m = 8"""


def fields(spark, sf):
    """Three fields an event: a short text, a check box, and a list of choices; some read-only."""
    rows = fx.table(spark, sf, "events").select(F.col("event_id").alias("doc_id"))
    made = F.array(
        F.struct(F.lit("name").alias("name"), F.lit("text").alias("type"), F.lit(True).alias("supported"), (F.col("doc_id") % 4 == 0).alias("read_only"), F.lit(5).alias("max_length"), F.array().cast("array<string>").alias("options"), F.lit('"old"').alias("current_json")),
        F.struct(F.lit("ok").alias("name"), F.lit("checkbox").alias("type"), F.lit(True).alias("supported"), F.lit(False).alias("read_only"), F.lit(None).cast("int").alias("max_length"), F.array().cast("array<string>").alias("options"), F.lit("true").alias("current_json")),
        F.struct(F.lit("list").alias("name"), F.lit("option-list").alias("type"), (F.col("doc_id") % 5 != 0).alias("supported"), F.lit(False).alias("read_only"), F.lit(None).cast("int").alias("max_length"), F.array(F.lit("a"), F.lit("b")).alias("options"), F.lit('["a"]').alias("current_json")),
    )
    return rows.select("doc_id", F.inline(made))


def good_values(spark, sf):
    return forms.parse_form_values(event_values(spark, sf)).filter("error_code IS NULL")


VALID = """WITH v AS (SELECT event_id AS d, event_id % 9 AS m, event_type AS t, CAST(user_id AS VARCHAR) AS u FROM events),
c AS (SELECT d, 'name' AS n, CASE WHEN d % 4 = 0 THEN 'read-only-field' WHEN length(CASE m WHEN 1 THEN t ELSE u END) > 5 THEN 'value-too-long' END AS code FROM v WHERE m IN (1, 5)
 UNION ALL SELECT d, 'ok', CASE WHEN m = 7 THEN 'type-mismatch' END FROM v WHERE m IN (1, 7) UNION ALL SELECT d, 'gone', 'field-not-found' FROM v WHERE m = 1
 UNION ALL SELECT d, 'list', CASE WHEN d % 5 = 0 THEN 'unsupported-field' WHEN m = 7 THEN 'unknown-choice' END FROM v WHERE m IN (5, 7)),
g AS (SELECT d, count(*) AS n, min(n) FILTER (WHERE code IS NOT NULL) AS f FROM c GROUP BY 1)
--
SELECT g.d AS doc_id, CASE WHEN f IS NULL THEN g.n ELSE 0 END AS changes, f IS NULL AS valid, f AS first_field, c.code AS error_code FROM g LEFT JOIN c ON c.d = g.d AND c.n = g.f"""
APPLIED = """WITH v AS (SELECT event_id AS d, event_id % 9 AS m, event_type AS t, CAST(user_id AS VARCHAR) AS u FROM events)
--
SELECT d AS doc_id, 'name' AS name, CASE m WHEN 1 THEN '"' || t || '"' WHEN 5 THEN '"' || u || '"' ELSE '"old"' END AS value_json, m IN (1, 5) AS changed FROM v
UNION ALL SELECT d, 'ok', CASE m WHEN 1 THEN 'true' WHEN 7 THEN '"yes"' ELSE 'true' END, m IN (1, 7) FROM v UNION ALL SELECT d, 'list', CASE m WHEN 5 THEN '["a","b"]' WHEN 7 THEN '"z"' ELSE '["a"]' END, m IN (5, 7) FROM v"""


def region_json(spark, sf):
    """Regions of orders as JSON; the first is sound, the second may leave the page, others are no regions."""
    one = "'{\"page\":' || (1 + o_orderkey % 4) || ',\"x\":' || (o_custkey % 60) || '.126,\"y\":5,\"width\":10.004,\"height\":' || (o_orderkey % 30) || '}'"
    two = "'{\"page\":' || (o_orderkey % 3) || ',\"x\":' || (o_custkey % 130) || ',\"y\":50,\"width\":30,\"height\":20}'"
    value = f"CASE o_orderkey % 10 WHEN 0 THEN '' WHEN 1 THEN '{{\"a\":1}}' WHEN 2 THEN '[oops' ELSE '[' || {one} || ',' || {two} || ']' END"
    return fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(value).alias("regions"), F.lit(3).alias("pages"))


REGIONS = """ro AS (SELECT o_orderkey AS d, o_custkey AS c, o_orderkey % 10 AS m FROM orders),
r1 AS (SELECT d, 1 AS ord, 1 + d % 4 AS page, floor((c % 60 + 0.126::DOUBLE) * 100 + 0.5) / 100 AS x, 5.0::DOUBLE AS y, 10.0::DOUBLE AS width, (d % 30)::DOUBLE AS height FROM ro WHERE m > 2 UNION ALL SELECT d, 2, d % 3, c % 130, 50, 30, 20 FROM ro WHERE m > 2),
regions AS (SELECT d AS doc_id, ord, page, x, y, width, height, CASE WHEN page < 1 OR page > 3 THEN 'invalid-redaction-page' WHEN height < 0.5 OR x + width > 100 OR y + height > 100 THEN 'redaction-region-out-of-bounds' END AS error_code FROM r1
 UNION ALL SELECT d, NULL, NULL, NULL, NULL, NULL, NULL, CASE m WHEN 1 THEN 'invalid-redaction-list' ELSE 'invalid-redaction-json' END FROM ro WHERE m IN (1, 2))"""


def regions(spark, sf):
    return forms.parse_regions(region_json(spark, sf))


def masked(spark, sf):
    """Order lines as cells of pages, under the orders' regions."""
    cells = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 3 + 1).cast("int").alias("page"), (F.col("l_quantity") * 2).alias("x"), (F.col("l_discount") * 1000).alias("y"), F.col("l_partkey").alias("value"))
    return forms.mask_regions(cells, materialize(regions(spark, sf), "regions"))  # read more than once, parsed once


STATS = """WITH {source},
runs AS (SELECT *, kind <> 'unchanged' AND kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY pair_id ORDER BY ord) AS starts FROM {rows})
--
SELECT pair_id, count(*) FILTER (WHERE kind = 'added') AS added, count(*) FILTER (WHERE kind = 'removed') AS removed, count(*) FILTER (WHERE kind = 'unchanged') AS unchanged,
  count(*) FILTER (WHERE kind <> 'unchanged') AS changed, count(*) FILTER (WHERE starts) AS changed_blocks, count(*) FILTER (WHERE starts) = 0 AS identical FROM runs GROUP BY 1"""
QUERIES = {
    "b1_admit_files": Query("job_id:l seq:l name:s error_code:s accepted:b running_bytes:d", admitted, f"WITH {ADMITTED}\n--\nSELECT job_id, seq, name, error_code, error_code IS NULL AS accepted, sum(CASE WHEN error_code IS NULL THEN size ELSE 0 END) OVER (PARTITION BY job_id ORDER BY seq) AS running_bytes FROM admitted"),
    "b1_admit_greedy": Query("job_id:l seq:l name:s error_code:s accepted:b running_bytes:d", greedy, GREEDY),
    "b2_rejection_summary": Query(
        "job_id:l accepted:l rejected:l message:s",
        lambda s, d: validate.rejection_summary(admitted(s, d)),
        f"WITH {ADMITTED},\n" + f"""rc AS (SELECT job_id, error_code, count(*) AS n, min(seq) AS f FROM admitted WHERE error_code IS NOT NULL GROUP BY 1, 2), rt AS (SELECT job_id, string_agg(n || {REASON}, ', ' ORDER BY f) AS t FROM rc GROUP BY 1),
jc AS (SELECT job_id, count(*) FILTER (WHERE error_code IS NULL) AS a, count(error_code) AS r FROM admitted GROUP BY 1)
--
SELECT job_id, a AS accepted, r AS rejected, CASE WHEN r = 0 THEN '' ELSE CASE WHEN a = 0 THEN '' WHEN a = 1 THEN a || ' file was added; ' ELSE a || ' files were added; ' END || r || CASE WHEN r = 1 THEN ' file was' ELSE ' files were' END || ' not added: ' || t || '.' END AS message FROM jc LEFT JOIN rt USING (job_id)""",
    ),
    "b3_resolve_policy": Query("slug:s key:s min_files:d max_files:d max_bytes:d", policies, POLICIES),
    "b4_check_min_files": Query(
        "job_id:l n_files:l shortfall:l error_code:s",
        lambda s, d: validate.check_min_files(fx.jobs_files(s, d), jobs(s, d)),
        "WITH j AS (SELECT user_id AS job_id FROM events UNION SELECT c_custkey FROM customer), c AS (SELECT user_id AS job_id, count(*) AS n FROM events GROUP BY 1)\n--\nSELECT job_id, coalesce(n, 0) AS n_files, greatest(0, job_id % 40 - coalesce(n, 0)) AS shortfall, CASE WHEN coalesce(n, 0) < job_id % 40 THEN 'not-enough-files' END AS error_code FROM j LEFT JOIN c USING (job_id)",
    ),
    "b5_preflight_totals": Query(
        "job_id:l total_pages:l total_pixels:l first_seq:l error_code:s",
        lambda s, d: validate.preflight_totals(meta(s, d), 48, 2000, 10_000_000),
        META + """,
r AS (SELECT *, sum(pages) OVER w AS p, sum(pixels) OVER w AS x FROM m WINDOW w AS (PARTITION BY job_id ORDER BY seq)), c AS (SELECT *, CASE WHEN pages < 1 THEN 'invalid-page-count' WHEN pages > 48 THEN 'too-many-pages' WHEN p > 2000 THEN 'too-many-total-pages' WHEN x > 10000000 THEN 'too-many-total-pixels' END AS code FROM r)
--
SELECT job_id, sum(pages) AS total_pages, sum(pixels) AS total_pixels, min(seq) FILTER (WHERE code IS NOT NULL) AS first_seq, arg_min(code, seq) FILTER (WHERE code IS NOT NULL) AS error_code FROM c GROUP BY 1""",
    ),
    "b6_result_budget": Query(
        "job_id:l seq:l retained:b error_code:s",
        lambda s, d: validate.result_budget(fx.jobs_files(s, d).filter("size > 0 AND NOT isnan(size)"), 25, 9500, 60_000),
        f"WITH {fx.JOB_FILES}," + """
r AS (SELECT job_id, seq, size, count(*) OVER w AS nth, sum(size) OVER w AS t FROM jobs_files WHERE size > 0 AND NOT isnan(size) WINDOW w AS (PARTITION BY job_id ORDER BY seq)),
c AS (SELECT *, CASE WHEN nth > 25 THEN 'result-count-limit' WHEN size > 9500 THEN 'archive-item-too-large' WHEN t > 60000 THEN 'archive-input-too-large' END AS code FROM r), b AS (SELECT *, count(code) OVER (PARTITION BY job_id ORDER BY seq) AS k FROM c)
--
SELECT job_id, seq, k = 0 AS retained, CASE WHEN k = 1 AND code IS NOT NULL THEN code END AS error_code FROM b""",
    ),
    "b8_screen_archives": Query("file_id:l n_entries:l expanded:d error_code:s", archives, ARCHIVES),
    "b9_check_settings": Query("job_id:l key:s value:s error_code:s", settings, "WITH r AS (SELECT p_type AS key FROM part GROUP BY 1 HAVING min(p_partkey) % 3 <> 0)\n--\nSELECT p_partkey AS job_id, p_type AS key, CASE WHEN p_partkey % 19 = 0 THEN 'many' ELSE CAST(p_size AS VARCHAR) END AS value, CASE WHEN r.key IS NULL THEN NULL WHEN p_partkey % 19 = 0 THEN 'invalid-number' WHEN p_size < 10 THEN 'below-minimum' WHEN p_size > 40 THEN 'above-maximum' END AS error_code FROM part LEFT JOIN r ON r.key = p_type"),
    "b10_check_text_lengths": Query("job_id:l seq:l characters:l running:l error_code:s", lambda s, d: validate.check_text_lengths(texts_of_turns(s, d), 400, 1200), "SELECT job_id, seq, c AS characters, r AS running, CASE WHEN c > 400 THEN 'text-setting-too-long' WHEN r > 1200 THEN 'extracted-text-limit' END AS error_code FROM (SELECT conv_id AS job_id, turn AS seq, length(text) AS c, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)"),
    "b11_unsupported_chars": Query("doc_id:l ord:l character:s code:s", odd_characters, ODD_CHARACTERS),
    "b12_duplicate_keys": Query(
        "item:l n:l problem:s",
        lambda s, d: validate.duplicate_keys(fx.table(s, d, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").cast("string").alias("key")), "grp", "key").select(F.col("grp").alias("item"), "n", "problem"),
        "SELECT l_orderkey AS item, count(*) AS n, 'duplicate' AS problem FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    ),
    "b13_scan_credentials": Query("doc_id:l rule:s", with_credentials, "SELECT doc_id, list_extract(['private-key', 'github', 'npm', 'aws', 'slack', 'url-password'], CAST(doc_id % 6 + 1 AS INTEGER)) AS rule FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL UNION ALL SELECT doc_id, 'aws' FROM documents WHERE regexp_matches(text, '\\bAKIA[0-9A-Z]{16}\\b') AND NOT (doc_id % 3 = 0 AND doc_id % 6 = 3)"),
    "b14_audit_paths": Query(
        "path:s size:l forbidden:b sensitive:b size_level:s",
        lambda s, d: validate.audit_paths(paths(s, d)),
        f"WITH {PATHS}\n--\nSELECT path, size, k IN (1, 2, 6, 7) AS forbidden, k IN (3, 4, 5) AS sensitive, CASE WHEN size >= 104857600 THEN 'error' WHEN size >= 52428800 THEN 'warning' END AS size_level FROM a",
    ),
    "b14_audit_summary": Query("files:l total:l largest_path:s largest:l forbidden:l sensitive:l size_issues:l", lambda s, d: validate.audit_summary(validate.audit_paths(paths(s, d))), f"WITH {PATHS}\n--\nSELECT count(*) AS files, sum(size) AS total, arg_max(path, size) AS largest_path, max(size) AS largest, count(*) FILTER (WHERE k IN (1, 2, 6, 7)) AS forbidden, count(*) FILTER (WHERE k IN (3, 4, 5)) AS sensitive, count(*) FILTER (WHERE size >= 52428800) AS size_issues FROM a"),
    "b15_check_links": Query("doc_id:l path:s", links, r"""WITH l AS (SELECT page_id, regexp_extract(trim(unnest(regexp_extract_all(html, 'href="([^"]*)"', 1))), '^\S+') AS t FROM pages), p AS (SELECT page_id, t, regexp_extract(t, '^[^#?]*') AS path FROM l)
--
SELECT DISTINCT page_id AS doc_id, path FROM p WHERE starts_with(t, '/') AND path <> '' AND path NOT IN (SELECT path FROM p WHERE page_id % 2 = 0)"""),
    "b16_check_placements": Query("doc_id:l ord:l error_code:s", placements, PLACEMENTS),
    "b17_sanitize_report": Query("page_id:l removed_elements:l removed_attributes:l removed_resources:l kept_images:l", lambda s, d: validate.sanitize_report(fx.table(s, d, "pages")), SANITIZE),
    "r1_diff_lines": Query(DIFF_COLUMNS, diff, f"WITH {fx.SCRIPT}\n--\nSELECT pair_id, ord, kind, left_line, right_line, text FROM script"),
    "r1_diff_identical": Query(DIFF_COLUMNS, identical_diff, f"WITH {fx.LINES}\n--\nSELECT doc_id * 2 AS pair_id, line AS ord, 'unchanged' AS kind, line AS left_line, line AS right_line, text FROM lines"),
    "r1_diff_numbered": Query(DIFF_COLUMNS, numbered_diff, f"WITH {fx.NUMBERED}\n--\nSELECT pair_id, ord, kind, left_line, right_line, text FROM numbered"),
    "r2_numbered_stats": Query(
        "pair_id:l added:l removed:l unchanged:l changed:l changed_blocks:l identical:b",
        lambda s, d: compare.diff_stats(numbered_diff(s, d)),
        STATS.format(source=fx.NUMBERED, rows="numbered"),
    ),
    "r2_view_limits": Query(
        "pair_id:l error_code:s",
        lambda s, d: compare.view_limits(numbered_diff(s, d), 900, 12),
        f"WITH {fx.NUMBERED}, v1 AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY pair_id ORDER BY ord) THEN 1 ELSE 0 END AS s FROM numbered), v2 AS (SELECT *, sum(s) OVER (PARTITION BY pair_id ORDER BY ord) AS block FROM v1),\n"
        "v3 AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY pair_id ORDER BY block) AS c FROM v2), v4 AS (SELECT pair_id, min(block) FILTER (WHERE c > 900) AS t, min(block) FILTER (WHERE ord > 12) AS l FROM v3 GROUP BY 1)\n--\n"
        "SELECT pair_id, CASE WHEN t <= l OR (t IS NOT NULL AND l IS NULL) THEN 'comparison-view-text-limit' WHEN l IS NOT NULL THEN 'comparison-view-line-limit' END AS error_code FROM v4",
    ),
    "r3_line_limits": Query(
        "pair_id:l error_code:s",
        lambda s, d: compare.pair_line_counts(*fx.diff_inputs(s, d), 20, 24).select("pair_id", "error_code"),
        f"WITH {fx.LINES}, k AS (SELECT doc_id, count(l.line) AS n, count(l.line) FILTER (WHERE l.line % 11 <> 0) AS m FROM documents LEFT JOIN lines l USING (doc_id) GROUP BY 1), c AS (SELECT doc_id * 2 AS pair_id, n, n AS m FROM k UNION ALL SELECT doc_id * 2 + 1, n, m FROM k)\n--\nSELECT pair_id, CASE WHEN greatest(n, m) > 20 THEN 'comparison-line-limit' WHEN n + m > 24 THEN 'comparison-total-line-limit' END AS error_code FROM c",
    ),
    "r2_diff_stats": Query("pair_id:l added:l removed:l unchanged:l changed:l changed_blocks:l identical:b", lambda s, d: compare.diff_stats(diff(s, d)), STATS.format(source=fx.SCRIPT, rows="script")),
    "r3_pair_line_counts": Query(
        "pair_id:l left_lines:l right_lines:l total_lines:l",
        lambda s, d: compare.pair_line_counts(*fx.diff_inputs(s, d)),
        f"WITH {fx.LINES}, k AS (SELECT doc_id, count(l.line) AS n, count(l.line) FILTER (WHERE l.line % 11 <> 0) AS m FROM documents LEFT JOIN lines l USING (doc_id) GROUP BY 1)\n--\nSELECT doc_id * 2 AS pair_id, n AS left_lines, n AS right_lines, 2 * n AS total_lines FROM k UNION ALL SELECT doc_id * 2 + 1, n, m, n + m FROM k",
    ),
    "r4_parse_form_values": Query("doc_id:l name:s kind:s value_json:s error_code:s", lambda s, d: forms.parse_form_values(event_values(s, d)), KINDS),
    "r5_validate_form": Query("doc_id:l changes:l valid:b first_field:s error_code:s", lambda s, d: forms.validate_form(good_values(s, d), fields(s, d)), VALID),
    "r6_apply_form_values": Query("doc_id:l name:s value_json:s changed:b", lambda s, d: forms.apply_form_values(fields(s, d), good_values(s, d)), APPLIED),
    "r7_form_stats": Query("doc_id:l fields:l options:l longest_name:l longest_value:l most_options:l characters:l", lambda s, d: forms.form_stats(fields(s, d)), "SELECT event_id AS doc_id, 3 AS fields, 2 AS options, 4 AS longest_name, 5 AS longest_value, 2 AS most_options, 26 AS characters FROM events"),
    "r8_parse_regions": Query("doc_id:l ord:l page:l x:d y:d width:d height:d error_code:s", regions, f"WITH {REGIONS}\n--\nSELECT * FROM regions"),
    "r9_region_plan": Query("doc_id:l regions:l pages:l page_list:s", lambda s, d: forms.region_plan(regions(s, d)), f"WITH {REGIONS}, u AS (SELECT DISTINCT doc_id, page FROM regions WHERE error_code IS NULL), n AS (SELECT doc_id, count(*) AS c FROM regions WHERE error_code IS NULL GROUP BY 1)\n--\nSELECT doc_id, max(c) AS regions, count(*) AS pages, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS page_list FROM u JOIN n USING (doc_id) GROUP BY 1"),
    "r9_clamp_regions": Query(
        "doc_id:l ord:l page:l x:d y:d width:d height:d",
        lambda s, d: forms.clamp_regions(regions(s, d).filter("ord IS NOT NULL")),
        f"WITH {REGIONS}, z AS (SELECT doc_id, ord, page, x, y, greatest(0.5::DOUBLE, least(100.0::DOUBLE, width)) AS w, CASE WHEN height = 0 THEN 0.5::DOUBLE ELSE greatest(0.5::DOUBLE, least(100.0::DOUBLE, height)) END AS h FROM regions WHERE ord IS NOT NULL)\n--\nSELECT doc_id, ord, greatest(1, page) AS page, floor(greatest(0, least(100 - w, x)) * 100 + 0.5) / 100 AS x, floor(greatest(0, least(100 - h, y)) * 100 + 0.5) / 100 AS y, w AS width, h AS height FROM z",
    ),
    "r10_mask_regions": Query(
        "doc_id:l page:l x:d y:d value:l masked:b",
        masked,
        f"WITH {REGIONS}, c AS (SELECT l_orderkey AS doc_id, l_linenumber % 3 + 1 AS page, l_quantity * 2 AS x, l_discount * 1000 AS y, l_partkey AS value FROM lineitem),\n" + "m AS (SELECT c.*, EXISTS (SELECT 1 FROM regions r WHERE r.error_code IS NULL AND r.doc_id = c.doc_id AND r.page = c.page AND c.x >= r.x AND c.x < r.x + r.width AND c.y >= r.y AND c.y < r.y + r.height) AS masked FROM c)\n--\nSELECT doc_id, page, x, y, CASE WHEN masked THEN 0 ELSE value END AS value, masked FROM m",
    ),
}
