"""Parts of office packages as tables: relationships, slides and word paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import WS, decode_entities, joined, trimmed

# The relationship and content types of slides.
SLIDE_RELATIONSHIPS = ("http://schemas.openxmlformats.org/officeDocument/2006/relationships/slide", "http://purl.oclc.org/ooxml/officeDocument/relationships/slide")
SLIDE_CONTENT = "application/vnd.openxmlformats-officedocument.presentationml.slide+xml"


def resolved(target: Column, folder: str) -> Column:
    """A part's name from a target relative to ``folder``; null if it is empty, has a scheme, a backslash, or leaves
    the package."""
    bad = target.isNull() | (target == "") | target.contains("\\") | target.rlike("(?i)^[a-z][a-z0-9+.-]*:") | target.startswith("//") | target.rlike("[?#]")
    path = F.when(target.startswith("/"), F.substring(target, 2, 100_000)).otherwise(F.concat(F.lit(f"{folder}/" if folder else ""), target))
    parts = F.filter(F.split(path, "/", -1), lambda p: (p != "") & (p != "."))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("out"))
    step = lambda s, p: F.when(p != "..", F.struct(F.array_append(s["kept"], p).alias("kept"), s["out"].alias("out"))).otherwise(F.struct(F.slice(s["kept"], F.lit(1), F.greatest(F.size(s["kept"]) - 1, F.lit(0))).alias("kept"), (s["out"] | (F.size(s["kept"]) == 0)).alias("out")))
    return F.when(~bad, F.aggregate(parts, start, step, lambda s: F.when(~s["out"] & (F.size(s["kept"]) > 0), F.array_join(s["kept"], "/"))))


def resolve_parts(order: DataFrame, rels: DataFrame, types: DataFrame, folder: str = "ppt") -> DataFrame:
    """doc_id, pos, part_name, error_code of ``order(doc_id, pos, rel_id)``: through ``rels(doc_id, id, type, target,
    mode)`` to parts of ``types(doc_id, part_name, content_type)``."""
    seen_id = Window.partitionBy("doc_id", "rel_id").orderBy("pos")
    listed = order.withColumn("nth_id", F.row_number().over(seen_id))
    by_id = rels.select("doc_id", F.col("id").alias("rel_id"), "type", "target", "mode").dropDuplicates(["doc_id", "rel_id"])
    found = listed.join(by_id, ["doc_id", "rel_id"], "left").withColumn("part_name", resolved(F.col("target"), folder)).join(types, ["doc_id", "part_name"], "left")
    nth = F.row_number().over(Window.partitionBy("doc_id", "part_name").orderBy("pos"))
    code = (
        F.when(F.coalesce("rel_id", F.lit("")) == "", "missing-relationship-id").when(F.col("nth_id") > 1, "ambiguous-pptx-slide-list")
        .when(F.col("type").isNull() | ~F.col("type").isin(*SLIDE_RELATIONSHIPS), "invalid-pptx-slide-relationship").when((F.coalesce("mode", F.lit("")) != "") & (F.lower("mode") != "internal"), "external-pptx-slide")
        .when(F.col("part_name").isNull(), "unsafe-part-path").when(~F.col("content_type").eqNullSafe(SLIDE_CONTENT), "invalid-pptx-structure").when(F.col("nth") > 1, "ambiguous-pptx-slide-list")
    )
    return found.withColumn("nth", nth).select("doc_id", "pos", "part_name", code.alias("error_code"))


def runs_text(xml: Column) -> Column:
    """The drawing text runs of a slide, white space collapsed, blank ones left out, joined by blanks."""
    runs = F.regexp_extract_all(xml, F.lit(r"<(?:[A-Za-z0-9_]+:)?t(?:\s[^>]*)?>([^<]*)</(?:[A-Za-z0-9_]+:)?t>"), F.lit(1))
    return F.array_join(F.filter(F.transform(runs, lambda t: trimmed(F.regexp_replace(decode_entities(t), f"{WS}+", " "))), lambda t: t != ""), " ")


def slide_text(parts: DataFrame, order: DataFrame) -> DataFrame:
    """doc_id, slide, part_name, text of ``parts(doc_id, part_name, xml)`` in the order of ``order(doc_id, pos, part_name)``."""
    return order.join(parts, ["doc_id", "part_name"]).select("doc_id", F.col("pos").alias("slide"), "part_name", runs_text(F.col("xml")).alias("text"))


def deck_text(slides: DataFrame) -> DataFrame:
    """doc_id, text: the slides under their numbers."""
    section = F.concat(F.lit("SLIDE "), F.col("slide").cast("string"), F.lit("\n"), F.col("text"))
    return slides.groupBy("doc_id").agg(joined(F.collect_list(F.struct("slide", section.alias("s"))), "s", "\n\n").alias("text"))


def word_text(parts: DataFrame) -> DataFrame:
    """doc_id, text, paragraphs of ``parts(doc_id, xml)``: deleted, moved and instruction runs go, of alternatives the
    fallback stays; paragraphs stand apart by a blank line; tabs, breaks, hyphens and symbols have their sign."""
    xml = F.regexp_extract(F.coalesce("xml", F.lit("")), r"(?s)<w:body(?:\s[^>]*)?>(.*)</w:body>", 1)
    xml = F.regexp_replace(xml, r"(?s)<mc:AlternateContent\b[^>]*>.*?(?:<mc:Fallback\b[^>]*>(.*?)</mc:Fallback>.*?)?</mc:AlternateContent>", "$1")
    for name in ("del", "moveFrom"):
        xml = F.regexp_replace(xml, rf"(?s)<w:{name}(?:\s[^>]*)?(?<!/)>.*?</w:{name}>", "")
    for name in ("delText", "instrText"):
        xml = F.regexp_replace(xml, rf"(?s)<w:{name}(?:\s[^>]*)?(?<!/)>[^<]*</w:{name}>", "")
    tokens = F.regexp_extract_all(xml, F.lit(r"<w:t(?:\s[^>]*)?>[^<]*</w:t>|</?w:p(?:\s[^>]*)?/?>|<w:(?:tab|br|cr|lastRenderedPageBreak|noBreakHyphen|softHyphen|sym)(?:\s[^>]*)?/?>"), F.lit(0))

    def sign(token: Column) -> Column:
        name = F.regexp_extract(token, r"^</?w:([A-Za-z]+)", 1)
        font, code = F.regexp_extract(token, r'w:font="\s*([\p{L}\p{N} ._-]{1,80}?)\s*"', 1), F.upper(F.regexp_extract(token, r'w:char="\s*([0-9A-Fa-f]{1,8})\s*"', 1))
        symbol = F.concat(F.lit("[symbol"), F.when(font != "", F.concat(F.lit(" "), font)).otherwise(""), F.when(code != "", F.concat(F.lit(" "), code)).otherwise(""), F.lit("]"))
        return (
            F.when(name == "t", decode_entities(F.regexp_extract(token, r"(?s)>([^<]*)<", 1))).when((name == "p") & ~token.startswith("</") & ~token.endswith("/>"), "\u0001").when((name == "p") & token.endswith("/>"), "\u0001").when(name == "p", "")
            .when(name == "tab", "\t").when(name.isin("br", "cr", "lastRenderedPageBreak"), "\n").when(name == "noBreakHyphen", "‑").when(name == "softHyphen", "­").when(name == "sym", symbol).otherwise("")
        )

    signs = F.transform(tokens, sign)
    joint = F.replace(F.array_join(signs, ""), F.lit("\u0001"), F.lit("\n\n"))
    text = F.when(F.element_at(signs, 1) == "\u0001", F.substring(joint, F.lit(3), F.length(joint))).otherwise(joint)
    return parts.select("doc_id", text.alias("text"), F.size(F.filter(signs, lambda s: s == "\u0001")).alias("paragraphs"))
