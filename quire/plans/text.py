"""Queries over text (operators C1 to C25)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import compare, packages, sheets, text
from quire.plans import fixtures as fx
from quire.plans.registry import Query

STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
WORDS_SQL = r"len(regexp_extract_all({t}, '\S+'))"


def html_pages(spark, sf):
    return text.html_to_text(fx.table(spark, sf, "pages")).select("page_id", "text")


def entities(spark, sf):
    from quire.functions.text import decode_entities

    return fx.table(spark, sf, "pages").select("page_id", decode_entities(F.col("html")).alias("text"))


NORMAL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '[\t ]+\n', chr(10), 'g'), '\n[\t ]+', chr(10), 'g'), ' {2,}', ' ', 'g'), '\t{2,}', chr(9), 'g'), '\n{3,}', chr(10) || chr(10), 'g')"""


def loose_text(spark, sf):
    from quire.functions.text import normalized

    return fx.docs(spark, sf).select("doc_id", normalized(F.replace(F.replace("text", F.lit("."), F.lit(".  \n\n\n \n")), F.lit(","), F.lit(",\t\t\r\n  "))).alias("text"))


def text_items(spark, sf):
    """Words of documents as placed items: a line is 12 units high, some items wander by less than 4."""
    words = fx.lines(spark, sf).select("doc_id", "line", F.posexplode(F.split("text", " ", -1)).alias("k", "str"))
    y = F.when(F.col("k") % 5 == 4, None).otherwise(800.0 - 12 * F.col("line") + (F.col("k") % 3) * 0.5)
    return words.select("doc_id", F.lit(1).alias("page"), (F.col("line") * 100_000 + F.col("k")).alias("item"), "str", y.alias("y"), (F.col("line") % 3 == 0) & (F.col("k") % 7 == 6))


def items(spark, sf):
    return text_items(spark, sf).toDF("doc_id", "page", "item", "str", "y", "has_eol")


ITEMS = fx.LINES + r""",
iw AS (SELECT doc_id, line, unnest(string_split(text, ' ')) AS str, generate_subscripts(string_split(text, ' '), 1) - 1 AS k FROM lines),
items AS (SELECT doc_id, line * 100000 + k AS item, str, CASE WHEN k % 5 = 4 THEN NULL ELSE 800.0::DOUBLE - 12 * line + (k % 3) * 0.5::DOUBLE END AS y, line % 3 = 0 AND k % 7 = 6 AS eol FROM iw),
i1 AS (SELECT *, last_value(y IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h FROM items),
i2 AS (SELECT *, lag(h) OVER (PARTITION BY doc_id ORDER BY item) AS was, lag(eol) OVER (PARTITION BY doc_id ORDER BY item) AS ended FROM i1),
i3 AS (SELECT *, sum(CASE WHEN coalesce(abs(h - was) > 4, false) OR coalesce(ended, false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY item) AS nth FROM i2),
i4 AS (SELECT doc_id, nth, trim(string_agg(str, ' ' ORDER BY item)) AS text FROM i3 GROUP BY 1, 2)"""


def recognised(spark, sf):
    confidence = F.expr("CASE WHEN page % 5 = 0 THEN double('NaN') WHEN page % 7 = 0 THEN NULL ELSE page * 13.5 - 20 END")
    return fx.doc_pages(spark, sf).select("doc_id", F.when(F.col("page") % 4 != 0, F.col("page")).alias("page"), F.col("page").alias("seq"), F.when(F.col("page") % 3 != 0, F.col("text")).alias("text"), confidence.alias("confidence"))


def markdown(spark, sf):
    """Markdown of conversations, with headings, lists and dividers among their lines."""
    rows = fx.lines(spark, sf)
    mark = F.expr("CASE line % 9 WHEN 1 THEN '## ' || text WHEN 2 THEN '- ' || text WHEN 3 THEN '* ' || text WHEN 4 THEN '1. ' || text WHEN 5 THEN '' WHEN 6 THEN '---' ELSE text END")
    from quire.functions.text import joined

    return rows.groupBy("doc_id").agg(joined(F.collect_list(F.struct("line", mark.alias("t"))), "t", "\n").alias("markdown"))


MD = fx.LINES + """,
md AS (SELECT doc_id, line, CASE line % 9 WHEN 1 THEN '## ' || text WHEN 2 THEN '- ' || text WHEN 3 THEN '* ' || text WHEN 4 THEN '1. ' || text WHEN 5 THEN '' WHEN 6 THEN '---' ELSE text END AS t FROM lines),
mk AS (SELECT *, CASE WHEN trim(t) = '' THEN 'blank' WHEN line % 9 = 1 THEN 'heading' WHEN t = '---' THEN 'divider' WHEN regexp_matches(t, '^\\s*[-*+]\\s+.+$') THEN 'list' WHEN regexp_matches(t, '^\\s*[0-9]+[.)]\\s+.+$') THEN 'ordered-list' ELSE 'paragraph' END AS type FROM md),
mi AS (SELECT *, sum(CASE WHEN type IN ('heading', 'divider', 'blank') OR type IS DISTINCT FROM was THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS g FROM (SELECT *, lag(type) OVER (PARTITION BY doc_id ORDER BY line) AS was FROM mk))"""


def own_glossary(spark, sf):
    """The first word of each benchmark item, to be replaced by the item's number."""
    return fx.table(spark, sf, "benchmark").select(F.lit("xx").alias("language"), F.regexp_extract("text", "[A-Za-z0-9_]+", 0).alias("term"), F.format_string("<%d>", "item_id").alias("replacement"))


def glossary(spark, sf, language="de"):
    return text.apply_glossary(fx.docs(spark, sf), language)


GLOSSARY_SQL = "CASE lower(w) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.GLOSSARIES["de"].items()) + " END"

SUMMARY = r"""WITH sl AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n+')) AS line, generate_subscripts(regexp_split_to_array(text, '\n+'), 1) AS k FROM documents),
ss AS (SELECT doc_id, k, unnest(a) AS s, generate_subscripts(a, 1) AS j FROM (SELECT doc_id, k, regexp_extract_all(trim(line), '[^.!?]+[.!?]+|[^.!?]+$') AS a FROM sl)),
sq AS (SELECT doc_id, k, j, trim(regexp_replace(s, '\s+', ' ', 'g')) AS s FROM ss), sr AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) AS o, s FROM sq WHERE s <> ''),
su AS (SELECT doc_id, lower(s) AS key, min(o) AS o, arg_min(s, o) AS s FROM sr GROUP BY 1, 2),
wc AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z''-]{3,}')) AS w FROM documents) WHERE w NOT IN (""" + STOPS + r""") GROUP BY 1, 2),
sw AS (SELECT doc_id, o, unnest(regexp_extract_all(key, '[a-z][a-z''-]{3,}')) AS w FROM su), sn AS (SELECT doc_id, o, sum(n) AS n FROM sw JOIN wc USING (doc_id, w) GROUP BY 1, 2),
rk AS (SELECT doc_id, o, s, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(coalesce(n, 0) AS DOUBLE) / greatest(8.0::DOUBLE, sqrt(length(s))) DESC, o) AS r FROM su LEFT JOIN sn USING (doc_id, o))
--
SELECT doc_id, string_agg('• ' || s, chr(10) ORDER BY o) AS summary, count(*) AS n_sentences FROM rk WHERE r <= 5 GROUP BY 1"""  # fmt: skip


def summary(spark, sf):
    return text.summarize(fx.docs(spark, sf))


def decks(spark, sf):
    """Conversations as decks, a slide a turn, in reverse order for odd ones."""
    turns = fx.table(spark, sf, "conversations")
    xml = F.concat(F.lit("<p:sld><p:txBody><a:p><a:r><a:t>"), F.col("role"), F.lit("</a:t></a:r><a:r><a:t xml:space='preserve'>  "), F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(" </a:t></a:r><a:r><a:t> </a:t></a:r></a:p></p:txBody></p:sld>"))
    name = F.concat(F.lit("ppt/slides/slide"), F.col("turn").cast("string"), F.lit(".xml"))
    return turns.select(F.col("conv_id").alias("doc_id"), "turn", name.alias("part_name"), xml.alias("xml"))


def slides(spark, sf):
    parts = decks(spark, sf)
    order = parts.select("doc_id", F.when(F.col("doc_id") % 2 == 1, -F.col("turn")).otherwise(F.col("turn")).alias("pos"), "part_name")
    return packages.slide_text(parts, order)


def relations(spark, sf):
    """Slide lists with a missing, an external, a foreign and a repeated relationship among them."""
    turns = fx.table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), "turn")
    order = turns.select("doc_id", F.col("turn").alias("pos"), F.expr("CASE WHEN (doc_id + turn) % 13 = 0 THEN 'rId0' ELSE 'rId' || turn END").alias("rel_id"))
    rels = turns.filter("(doc_id + turn) % 7 <> 0").select(
        "doc_id", F.expr("'rId' || turn").alias("id"), F.expr(f"CASE WHEN turn % 6 = 5 THEN 'http://x/notes' ELSE '{packages.SLIDE_RELATIONSHIPS[0]}' END").alias("type"),
        F.expr("CASE WHEN turn % 4 = 3 THEN 'slides/../slides/slide' || (turn - 1) || '.xml' WHEN doc_id % 9 = 8 THEN '../../x' || turn ELSE 'slides/slide' || turn || '.xml' END").alias("target"), F.expr("CASE WHEN doc_id % 10 = 7 THEN 'External' END").alias("mode"),
    )
    types = turns.select("doc_id", F.expr("'ppt/slides/slide' || turn || '.xml'").alias("part_name"), F.lit(packages.SLIDE_CONTENT).alias("content_type"))
    return packages.resolve_parts(order, rels, types)


RELATIONS = f"""WITH o AS (SELECT conv_id AS d, turn AS pos, CASE WHEN (conv_id + turn) % 13 = 0 THEN 'rId0' ELSE 'rId' || turn END AS id FROM conversations),
r AS (SELECT conv_id AS d, 'rId' || turn AS id, turn % 6 <> 5 AS slide, CASE WHEN turn % 4 = 3 THEN 'ppt/slides/slide' || (turn - 1) || '.xml' WHEN conv_id % 9 = 8 THEN NULL ELSE 'ppt/slides/slide' || turn || '.xml' END AS part, conv_id % 10 = 7 AS ext FROM conversations WHERE (conv_id + turn) % 7 <> 0),
p AS (SELECT conv_id AS d, 'ppt/slides/slide' || turn || '.xml' AS part, true AS ok FROM conversations),
j AS (SELECT o.d, pos, o.id, row_number() OVER (PARTITION BY o.d, o.id ORDER BY pos) AS nid, r.slide, r.part, r.ext, p.ok, row_number() OVER (PARTITION BY o.d, r.part ORDER BY pos) AS np FROM o LEFT JOIN r ON o.d = r.d AND o.id = r.id LEFT JOIN p ON p.d = o.d AND p.part = r.part)
--
SELECT d AS doc_id, pos, part AS part_name, CASE WHEN nid > 1 THEN 'ambiguous-pptx-slide-list' WHEN slide IS NULL OR NOT slide THEN 'invalid-pptx-slide-relationship' WHEN ext THEN 'external-pptx-slide' WHEN part IS NULL THEN 'unsafe-part-path' WHEN ok IS NULL THEN 'invalid-pptx-structure' WHEN np > 1 THEN 'ambiguous-pptx-slide-list' END AS error_code FROM j"""


def words(spark, sf):
    """Word bodies: a paragraph a line, every third with a tab, every fifth with a deletion, an empty one at the end."""
    run = "'<w:r><w:t>' || replace(replace(text, '&', '&amp;'), '<', '&lt;') || '</w:t></w:r>'"
    extra = "CASE WHEN line % 3 = 0 THEN '<w:r><w:tab/><w:t>x</w:t></w:r>' ELSE '' END || CASE WHEN line % 5 = 0 THEN '<w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:r><w:instrText>PAGE</w:instrText><w:br/></w:r>' ELSE '' END"
    from quire.functions.text import joined

    body = fx.lines(spark, sf).select("doc_id", "line", F.expr(f"'<w:p>' || {run} || {extra} || '</w:p>'").alias("p")).groupBy("doc_id").agg(joined(F.collect_list(F.struct("line", "p")), "p", "").alias("b"))
    return packages.word_text(body.select("doc_id", F.concat(F.lit("<w:document><w:body>"), "b", F.lit("<w:p/></w:body></w:document>")).alias("xml")))


REPORT = f"WITH {fx.NUMBERED}\n--\n" + r"""SELECT pair_id, string_agg('<div class="diff-row ' || kind || '"><span class="marker">' || CASE kind WHEN 'added' THEN '+' WHEN 'removed' THEN '−' ELSE '' END || '</span><span class="line">' || coalesce(CAST(left_line AS VARCHAR), '') || '</span><span class="line">' || coalesce(CAST(right_line AS VARCHAR), '') || '</span><pre>'
  || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#039;') || '</pre></div>', '' ORDER BY ord) AS html FROM numbered GROUP BY 1"""
#: Each text's pieces folded into one: on the same line while it stays within the width.
REFLOW = r"""WITH w1 AS (SELECT doc_id, unnest(string_split_regex(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) AS w, generate_subscripts(string_split_regex(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), 1) AS k FROM documents WHERE regexp_matches(text, '\S')),
w2 AS (SELECT doc_id, k, i, substring(w, CAST(i * 60 + 1 AS BIGINT), 60) AS p FROM (SELECT doc_id, k, w, unnest(generate_series(0, (length(w) - 1) // 60)) AS i FROM w1)),
w3 AS (SELECT doc_id, list({'t': p, 'n': length(p)} ORDER BY k, i) AS ps FROM w2 GROUP BY 1),
w4 AS (SELECT doc_id, list_reduce(ps, lambda a, b: CASE WHEN a.n + 1 + b.n <= 60 THEN {'t': a.t || ' ' || b.t, 'n': a.n + 1 + b.n} ELSE {'t': a.t || chr(10) || b.t, 'n': b.n} END).t AS t FROM w3)
--
SELECT doc_id, generate_subscripts(string_split(t, chr(10)), 1) AS line, unnest(string_split(t, chr(10))) AS text FROM w4"""
#: For pages whose tags are closed and quoted as usual, as the given ones are.
HTML_STEPS = [("<!--.*?-->", ""), ("|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in text.IGNORED.split("|")), ""), (r"^.*?<body\b[^>]*>", ""), (r"</body\b.*$", ""), (r"\s+", " "), (r"</?br\b[^>]*>", "\n"), (r"</?hr\b[^>]*>", "\n\n"), (r"<li\b[^>]*>", "\n- "), (r"</(?:td|th)\b[^>]*>", "\t"), (r"</tr\b[^>]*>", "\n"), (rf"</(?:{text.PARAGRAPH})\b[^>]*>", "\n\n"), (r"<[^>]*>", "")]
HTML = "html"
for _pattern, _to in HTML_STEPS:
    HTML = f"regexp_replace({HTML}, '{_pattern}', '{_to}', 'gis')"
for _name, _sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("nbsp", " "), ("amp", "&")):
    HTML = f"replace({HTML}, '&{_name};', '{_sign}')"
HTML = rf"SELECT page_id, regexp_replace({NORMAL}, '^\s+|\s+$', '', 'g') AS text FROM (SELECT page_id, {HTML} AS t FROM pages)"


QUERIES = {
    "c1_logical_lines": Query("doc_id:l line:l text:s", fx.lines, f"WITH {fx.LINES}\n--\nSELECT doc_id, line, text FROM lines"),
    "c2_html_to_text": Query("page_id:l text:s", html_pages, HTML),
    "c3_decode_entities": Query("page_id:l text:s", entities, "SELECT page_id, replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&copy;', '©'), '&nbsp;', ' '), '&amp;', '&') AS text FROM pages"),
    "c4_normalize_text": Query("doc_id:l text:s", loose_text, "SELECT doc_id, regexp_replace(" + NORMAL + r", '^\s+|\s+$', '', 'g') AS text FROM (SELECT doc_id, replace(replace(text, '.', '.  ' || repeat(chr(10), 3) || ' ' || chr(10)), ',', ',' || chr(9) || chr(9) || chr(13) || chr(10) || '  ') AS t FROM documents)"),
    "c5_stitch_lines": Query("doc_id:l line:l text:s", lambda s, d: text.stitch_lines(items(s, d)), f"WITH {ITEMS}\n--\nSELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS line, text FROM i4 WHERE text <> ''"),
    "c6_page_text_stats": Query(
        "doc_id:l page:l characters:l words:l pages:l pages_with_text:l empty_pages:l preview:s truncated:b",
        lambda s, d: text.page_text_stats(fx.doc_pages(s, d), 40),
        f"WITH {fx.DOC_PAGES}\n--\n" + "SELECT doc_id, page, sum(length(text)) AS characters, sum(" + WORDS_SQL.format(t="text") + r") AS words, count(*) AS pages, count(*) FILTER (WHERE regexp_matches(text, '\S')) AS pages_with_text, count(*) FILTER (WHERE NOT regexp_matches(text, '\S')) AS empty_pages, CASE WHEN grouping(page) = 0 THEN max(left(text, 40)) END AS preview, bool_or(length(text) > 40) AS truncated FROM doc_pages GROUP BY GROUPING SETS ((doc_id, page), (doc_id))",
    ),
    "c7_text_stats": Query(
        "doc_id:l characters:l words:l paragraphs:l symbols:l unicode_words:l preview:s truncated:b",
        lambda s, d: text.text_stats(fx.docs(s, d), 100),
        "SELECT doc_id, length(text) AS characters, " + WORDS_SQL.format(t="text") + r" AS words, len([x for x in regexp_split_to_array(text, '\n{2,}') if regexp_matches(x, '\S')]) AS paragraphs, len(regexp_extract_all(text, '\[symbol(?: [^\]]+)?\]')) AS symbols, len(regexp_extract_all(regexp_replace(text, '\[symbol(?: [^\]]+)?\]', ' ', 'g'), '[\p{L}\p{N}]+(?:[’''-][\p{L}\p{N}]+)*')) AS unicode_words, left(text, 100) AS preview, length(text) > 100 AS truncated FROM documents",
    ),
    "c8_lines_to_cells": Query(
        "doc_id:l page:l row:l col:l value:s",
        lambda s, d: sheets.lines_to_cells(fx.doc_pages(s, d)),
        f"WITH {fx.DOC_PAGES},\n" + r"""cr AS (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS row FROM doc_pages WHERE regexp_matches(text, '\S'))
--
SELECT doc_id, page, row, trim(unnest(regexp_split_to_array(l, '\s{2,}|\t|\|'))) AS value, generate_subscripts(regexp_split_to_array(l, '\s{2,}|\t|\|'), 1) AS col FROM cr""",
    ),
    "c9_sheet_plan": Query(
        "doc_id:l page:l name:s rows:l n_values:l columns:l cut_rows:b cut_columns:b",
        lambda s, d: sheets.sheet_plan(fx.doc_pages(s, d), 3, 2),
        f"WITH {fx.DOC_PAGES},\n" + r"""cr AS (SELECT doc_id, page, regexp_split_to_array(unnest(string_split(text, chr(10))), '\s{2,}|\t|\|') AS c FROM doc_pages WHERE regexp_matches(text, '\S')),
ca AS (SELECT doc_id, page, count(*) AS rows, sum(len([x for x in c if trim(x) <> ''])) AS n_values, max(len(c)) AS columns FROM cr GROUP BY 1, 2)
--
SELECT doc_id, page, 'Page ' || page AS name, coalesce(rows, 0) AS rows, coalesce(n_values, 0) AS n_values, coalesce(columns, 0) AS columns, coalesce(rows, 0) > 3 AS cut_rows, coalesce(columns, 0) > 2 AS cut_columns FROM doc_pages LEFT JOIN ca USING (doc_id, page)""",
    ),
    "c10_workbook_stats": Query(
        "doc_id:l sheet_no:l start_row:l start_column:l n_rows:l n_columns:l slots:l n_values:l sheets:l sheets_with_values:l",
        lambda s, d: sheets.workbook_stats(fx.cells(s, d)),
        f"WITH {fx.CELLS},\n" + """w AS (SELECT doc_id, sheet_no, min(row) + 1 AS a, min(col) AS b, max(row) - min(row) + 1 AS r, max(col) - min(col) + 1 AS c, count(*) FILTER (WHERE trim(value) <> '') AS v FROM cell_rows GROUP BY 1, 2)
--
SELECT doc_id, sheet_no, a AS start_row, b AS start_column, r AS n_rows, c AS n_columns, r * c AS slots, v AS n_values, 1 AS sheets, CASE WHEN v > 0 THEN 1 ELSE 0 END AS sheets_with_values FROM w
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, sum(r * c), sum(v), count(*), count(*) FILTER (WHERE v > 0) FROM w GROUP BY 1""",
    ),
    "c11_workbook_text": Query(
        "doc_id:l text:s",
        lambda s, d: sheets.workbook_text(fx.cells(s, d)),
        f"WITH {fx.CELLS},\n" + """g AS (SELECT doc_id, sheet_no, sheet, row, max(value) FILTER (WHERE col = 1) AS v1, max(value) FILTER (WHERE col = 3) AS v3 FROM cell_rows GROUP BY 1, 2, 3, 4),
s AS (SELECT doc_id, sheet_no, sheet || chr(10) || string_agg(CASE WHEN v3 IS NULL THEN v1 ELSE v1 || '  |    |  ' || v3 END, chr(10) ORDER BY row) AS t FROM g GROUP BY doc_id, sheet_no, sheet)
--
SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY sheet_no) AS text FROM s GROUP BY 1""",
    ),
    "c11_workbook_limit": Query(
        "doc_id:l text:s error_code:s",
        lambda s, d: sheets.workbook_text(fx.cells(s, d), 400),
        f"WITH {fx.CELLS},\n" + """g AS (SELECT doc_id, sheet_no, sheet, row, max(value) FILTER (WHERE col = 1) AS v1, max(value) FILTER (WHERE col = 3) AS v3 FROM cell_rows GROUP BY 1, 2, 3, 4),
s AS (SELECT doc_id, sheet_no, (max(row) - min(row) + 1) * CASE WHEN count(v3) > 0 THEN 3 ELSE 1 END AS slots, sheet || chr(10) || string_agg(CASE WHEN v3 IS NULL THEN v1 ELSE v1 || '  |    |  ' || v3 END, chr(10) ORDER BY row) AS t FROM g GROUP BY doc_id, sheet_no, sheet)
--
SELECT doc_id, CASE WHEN sum(slots) <= 400 THEN string_agg(t, chr(10) || chr(10) ORDER BY sheet_no) END AS text, CASE WHEN sum(slots) > 400 THEN 'spreadsheet-cell-limit' END AS error_code FROM s GROUP BY 1""",
    ),
    "c12_cell_preview": Query(
        "doc_id:l sheet_no:l row:l col:l value:s",
        lambda s, d: sheets.cell_preview(fx.cells(s, d), 8, 2, 10),
        f"WITH {fx.CELLS}\n--\nSELECT * FROM (SELECT doc_id, sheet_no, row - min(row) OVER w + 1 AS row, col - min(col) OVER w + 1 AS col, CASE WHEN length(value) > 10 THEN left(value, 9) || '…' ELSE value END AS value FROM cell_rows WINDOW w AS (PARTITION BY doc_id, sheet_no)) WHERE row <= 8 AND col <= 2",
    ),
    "c13_resolve_parts": Query("doc_id:l pos:l part_name:s error_code:s", relations, RELATIONS),
    "c14_slide_text": Query("doc_id:l slide:l part_name:s text:s", slides, r"SELECT conv_id AS doc_id, CASE WHEN conv_id % 2 = 1 THEN -turn ELSE turn END AS slide, 'ppt/slides/slide' || turn || '.xml' AS part_name, trim(role || ' ' || trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text FROM conversations"),
    "c14_deck_text": Query("doc_id:l text:s", lambda s, d: packages.deck_text(slides(s, d)), r"SELECT conv_id AS doc_id, string_agg('SLIDE ' || p || chr(10) || t, chr(10) || chr(10) ORDER BY p) AS text FROM (SELECT conv_id, CASE WHEN conv_id % 2 = 1 THEN -turn ELSE turn END AS p, trim(role || ' ' || trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM conversations) GROUP BY 1"),
    "c15_word_text": Query(
        "doc_id:l text:s paragraphs:l",
        words,
        f"WITH {fx.LINES}\n--\nSELECT doc_id, string_agg(text || CASE WHEN line % 3 = 0 THEN chr(9) || 'x' ELSE '' END || CASE WHEN line % 5 = 0 THEN chr(10) ELSE '' END, chr(10) || chr(10) ORDER BY line) || chr(10) || chr(10) AS text, count(*) + 1 AS paragraphs FROM lines GROUP BY 1",
    ),
    "c16_render_sections": Query("doc_id:l text:s", lambda s, d: text.render_sections(fx.doc_pages(s, d)), f"WITH {fx.DOC_PAGES}\n--\n" + r"SELECT doc_id, string_agg('PAGE ' || page || chr(10) || CASE WHEN NOT regexp_matches(text, '\S') THEN '[No text recognized]' ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END, chr(10) || chr(10) ORDER BY page) AS text FROM doc_pages GROUP BY 1"),
    "c17_clean_recognition": Query(
        "doc_id:l page:l text:s confidence:l total_characters:l",
        lambda s, d: text.clean_recognition(recognised(s, d)),
        f"WITH {fx.DOC_PAGES}\n--\nSELECT doc_id, page, CASE WHEN page % 3 <> 0 THEN text ELSE '' END AS text, CASE WHEN page % 5 = 0 OR page % 7 = 0 THEN NULL ELSE greatest(0, least(100, floor(page * 13.5 - 20 + 0.5))) END AS confidence, sum(CASE WHEN page % 3 <> 0 THEN length(text) ELSE 0 END) OVER (PARTITION BY doc_id) AS total_characters FROM doc_pages",
    ),
    "c18_pages_to_markdown": Query(
        "doc_id:l markdown:s",
        lambda s, d: text.pages_to_markdown(fx.doc_pages(s, d), True),
        f"WITH {fx.LINES},\n" + r"""ml AS (SELECT doc_id, (line - 1) // 4 + 1 AS page, line, CASE WHEN length(text) < 72 AND regexp_matches(text, '^[A-Z0-9\s:&-]+$') THEN '## ' || regexp_replace(text, '\s+', ' ', 'g') WHEN regexp_matches(text, '^[•*-]') THEN '- ' || regexp_replace(text, '^[•*-]\s*', '') ELSE text END AS t, text <> '' AS shown FROM lines),
mp AS (SELECT doc_id, page, '# Page ' || page || chr(10) || chr(10) || coalesce(string_agg(t, chr(10) || chr(10) ORDER BY line) FILTER (WHERE shown), '') AS t FROM ml GROUP BY 1, 2)
--
SELECT doc_id, string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page) AS markdown FROM mp GROUP BY 1""",
    ),
    "c19_markdown_blocks": Query(
        "doc_id:l block:l type:s n_items:l",
        lambda s, d: text.markdown_blocks(markdown(s, d)).select("doc_id", "block", "type", F.coalesce(F.size("items"), F.lit(0)).alias("n_items")),
        "WITH " + MD.replace("\\\\", "\\") + "\n--\nSELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) AS block, type, CASE WHEN type IN ('list', 'ordered-list') THEN n ELSE 0 END AS n_items FROM (SELECT doc_id, g, type, count(*) AS n FROM mi WHERE type <> 'blank' GROUP BY 1, 2, 3)",
    ),
    "c20_chunk_text": Query("doc_id:l chunk:l text:s", lambda s, d: text.chunk_text(fx.docs(s, d)), "SELECT doc_id, c + 1 AS chunk, substring(text, c * 3500 + 1, 3500) AS text FROM (SELECT doc_id, text, unnest(generate_series(0, (length(text) - 1) // 3500)) AS c FROM documents WHERE length(text) > 0)"),
    "c21_apply_glossary": Query(
        "doc_id:l replacements:l body:s",
        glossary,
        r"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+')) AS w, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), 1) AS k FROM documents), r AS (SELECT doc_id, k, w, " + GLOSSARY_SQL + " AS x FROM t)\n--\nSELECT doc_id, count(x) AS replacements, string_agg(coalesce(x, w), '' ORDER BY k) AS body FROM r GROUP BY 1 UNION ALL SELECT doc_id, 0, '' FROM documents WHERE coalesce(text, '') = ''",
    ),
    "c21_glossary_table": Query(
        "doc_id:l replacements:l body:s",
        lambda s, d: text.apply_glossary(fx.docs(s, d), "XX", own_glossary(s, d)),
        r"""WITH g AS (SELECT lower(regexp_extract(text, '[A-Za-z0-9_]+')) AS term, min('<' || item_id || '>') AS x FROM benchmark WHERE regexp_matches(text, '[A-Za-z0-9_]') GROUP BY 1),
t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+')) AS w, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), 1) AS k FROM documents)
--
SELECT doc_id, count(x) AS replacements, string_agg(coalesce(x, w), '' ORDER BY k) AS body FROM t LEFT JOIN g ON lower(w) = term GROUP BY 1 UNION ALL SELECT doc_id, 0, '' FROM documents WHERE coalesce(text, '') = ''""",
    ),
    "c22_summarize": Query("doc_id:l summary:s n_sentences:l", summary, SUMMARY),
    "c23_paginate_lines": Query("doc_id:l line:l page:l line_on_page:l", lambda s, d: text.paginate_lines(fx.lines(s, d)), f"WITH {fx.LINES}\n--\nSELECT doc_id, line, (line + 45) // 46 AS page, (line - 1) % 46 + 1 AS line_on_page FROM lines"),
    "c24_reflow": Query("doc_id:l line:l text:s", lambda s, d: text.reflow(fx.docs(s, d), 60), REFLOW),
    "c25_numbered_report": Query("pair_id:l html:s", lambda s, d: compare.pair_reports(*fx.numbered_diff_inputs(s, d)), REPORT),
    "c25_diff_report": Query("pair_id:l html:s", lambda s, d: compare.pair_reports(*fx.diff_inputs(s, d)), REPORT.replace(fx.NUMBERED, fx.SCRIPT).replace("FROM numbered", "FROM script")),
}
