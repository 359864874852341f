"""Text of documents: lines, HTML, sentences, Markdown, glossaries, chunks and sections.

All are plans of built-in functions; rows of one document meet only in that document's own aggregates.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import WS, decode_entities, joined, n_words, normalized, trimmed, unix_lines

# Element classes, the summary's stop words, and the glossaries.
IGNORED = "canvas|embed|form|head|iframe|math|noscript|object|script|style|svg|template"
PARAGRAPH = "address|article|aside|blockquote|caption|dd|div|dl|dt|fieldset|figcaption|figure|footer|h1|h2|h3|h4|h5|h6|header|main|nav|ol|p|section|table|tbody|tfoot|thead|ul"
STOP_WORDS = (
    "about after again also and are because been before being between both but can could did does doing down during each few for from further had has have having her here hers herself "
    "him himself his how into its itself just more most other our ours ourselves out over own same she should some such than that the their theirs them themselves then there these they "
    "this those through too under until very was were what when where which while who whom why will with you your yours yourself yourselves"
).split()
GLOSSARIES = {
    "es": {"document": "documento", "page": "página", "private": "privado", "local": "local", "file": "archivo", "image": "imagen", "text": "texto", "with": "con", "and": "y", "the": "el"},
    "fr": {"document": "document", "page": "page", "private": "privé", "local": "local", "file": "fichier", "image": "image", "text": "texte", "with": "avec", "and": "et", "the": "le"},
    "de": {"document": "Dokument", "page": "Seite", "private": "privat", "local": "lokal", "file": "Datei", "image": "Bild", "text": "Text", "with": "mit", "and": "und", "the": "die"},
    "hi": {"document": "दस्तावेज़", "page": "पृष्ठ", "private": "निजी", "local": "स्थानीय", "file": "फ़ाइल", "image": "छवि", "text": "पाठ", "with": "के साथ", "and": "और", "the": "यह"},
}

SUMMARY_WORD, SUMMARY_STOP = re.compile(r"[a-z][a-z'-]{3,}"), frozenset(STOP_WORDS)
ASCII_WORD, GAP = re.compile(r"[A-Za-z0-9_]+"), re.compile(f"{WS}+")
#: Bytes of a glossary that is broadcast.
MAX_GLOSSARY = 16 << 20

# Possessive tag bodies: a long tag costs no stack.
BODY = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
END = r"""(?:>|["'].*\z|\z)"""
HTML_TOKEN = (
    rf"(?is)<!--.*?(?:-->|\z)"
    rf"|<\s*(?:[a-z][a-z0-9-]*:)*({IGNORED})(?![a-z0-9:-]){BODY}(?<!/\s{{0,9}})>(?:.*?<\s*/\s*(?:[a-z][a-z0-9-]*:)?\1\s*{BODY}{END}|.*\z)"
    rf"|<{BODY}{END}|[^<]++"
)
TAG = r"(?is)^<\s*(/?)\s*(?:[a-z][a-z0-9-]*:)*([a-z][a-z0-9-]*).*>$"
# What a tag becomes; all others become nothing.
SHOWN_TAGS = {"br": "\n", "/br": "\n", "hr": "\n\n", "/hr": "\n\n", "li": "\n- ", "/td": "\t", "/th": "\t", "/tr": "\n"} | {f"/{p}": "\n\n" for p in PARAGRAPH.split("|")}


def split_lines(text: Column) -> Column:
    """The lines of a text that isn't empty; a final line end adds none."""
    return F.split(F.regexp_replace(unix_lines(text), r"\n\z", ""), "\n", -1)


def logical_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, line (from 1), text. A final line end adds no line; an empty or null text has none."""
    lines = split_lines(F.col(text))
    return docs.filter(F.length(text) > 0).select("doc_id", F.posexplode(lines).alias("line", "text")).withColumn("line", F.col("line") + 1)


def html_to_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text``, the readable text of markup; null markup is empty.

    One pass over its tags, comments, ignored containers and texts, in steps that each work on the fields of the
    step before: tokens; a tag's name (with a slash if it closes); what each token shows; what lies in the body.
    """
    shown = F.create_map(*[F.lit(x) for pair in SHOWN_TAGS.items() for x in pair])
    other = F.lit("other")
    tag = lambda t: F.when(~t.startswith("<"), F.lit(None)).when(t.startswith("<!--"), other).otherwise(F.lower(F.regexp_replace(t, TAG, "$1$2")))
    text = lambda t: F.regexp_replace(decode_entities(t), f"{WS}+", " ")
    tokens = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(HTML_TOKEN), F.lit(0))
    named = pages.withColumn("_tokens", F.transform(tokens, lambda t: F.struct(t.alias("token"), tag(t).alias("tag"))))
    opened = F.array_position(F.transform("_tokens", lambda p: p["tag"]), "body").cast("int")
    inner = named.withColumn("_from", opened + 1)
    closed = F.array_position(F.transform(F.slice("_tokens", "_from", F.size("_tokens")), lambda p: p["tag"]), "/body").cast("int")
    body = inner.withColumn("_to", F.when(closed > 0, closed - 1).otherwise(F.size("_tokens")))
    out = F.transform(F.slice("_tokens", "_from", "_to"), lambda p: F.when(p["tag"].isNull(), text(p["token"])).otherwise(F.try_element_at(shown, p["tag"])))
    return body.withColumn("text", normalized(F.array_join(out, ""))).drop("_tokens", "_from", "_to")


def text_stats(docs: DataFrame, preview: int = 1600, text: str = "text") -> DataFrame:
    """doc_id, characters, words, paragraphs, symbols, unicode_words, preview, truncated."""
    body = F.coalesce(text, F.lit(""))
    plain = F.regexp_replace(body, r"\[symbol(?: [^\]]+)?\]", " ")
    return docs.select(
        "doc_id",
        F.length(body).alias("characters"),
        n_words(body).alias("words"),
        F.size(F.filter(F.split(body, r"\n{2,}", -1), lambda p: F.length(trimmed(p)) > 0)).alias("paragraphs"),
        F.size(F.regexp_extract_all(body, F.lit(r"\[symbol(?: [^\]]+)?\]"), F.lit(0))).alias("symbols"),
        F.size(F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}]+(?:[’'-][\p{L}\p{N}]+)*"), F.lit(0))).alias("unicode_words"),
        F.left(body, F.lit(preview)).alias("preview"),
        (F.length(body) > preview).alias("truncated"),
    )


def page_text_stats(pages: DataFrame, preview: int = 1600) -> DataFrame:
    """Of ``pages(doc_id, page, text)``: a row a page, and one a document (page null) with its totals."""
    text = F.coalesce("text", F.lit(""))
    facts = pages.select("doc_id", "page", F.length(text).alias("c"), n_words(text).alias("w"), (F.length(trimmed(text)) > 0).alias("has"), F.left(text, F.lit(preview)).alias("p"), (F.length(text) > preview).alias("cut"))
    sums = [F.sum("c").alias("characters"), F.sum("w").alias("words"), F.count("*").alias("pages"), F.count_if("has").alias("pages_with_text"), F.count_if(~F.col("has")).alias("empty_pages")]
    return facts.groupingSets([["doc_id", "page"], ["doc_id"]], "doc_id", "page").agg(*sums, F.when(F.grouping("page") == 0, F.max("p")).alias("preview"), F.bool_or("cut").alias("truncated"))


def stitch_lines(items: DataFrame, gap: float = 4.0) -> DataFrame:
    """doc_id, page, line, text from ``items(doc_id, page, item, str, y, has_eol)``: a new line where the height
    changes by more than ``gap`` or after an end-of-line mark; a missing height is the one before; blank
    lines are left out."""
    order = Window.partitionBy("doc_id", "page").orderBy("item")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    moved = items.withColumn("at", F.last("y", ignorenulls=True).over(so_far)).withColumn("was", F.lag("at").over(order)).withColumn("ended", F.coalesce(F.lag("has_eol").over(order), F.lit(False)))
    starts = F.coalesce(F.abs(F.col("at") - F.col("was")) > gap, F.lit(False)) | F.col("ended")
    lines = moved.withColumn("nth", F.sum(starts.cast("int")).over(so_far)).groupBy("doc_id", "page", "nth")
    text = lines.agg(trimmed(joined(F.collect_list(F.struct("item", F.coalesce("str", F.lit("")).alias("s"))), "s", " ")).alias("text")).filter("text <> ''")
    return text.select("doc_id", "page", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("nth")).alias("line"), "text")


def render_sections(pages: DataFrame, label: str = "PAGE", placeholder: str = "[No text recognized]") -> DataFrame:
    """doc_id, text: every page under its heading, a placeholder where it is blank."""
    text = trimmed(F.coalesce("text", F.lit("")))
    section = F.concat(F.lit(f"{label} "), F.col("page").cast("string"), F.lit("\n"), F.when(text == "", placeholder).otherwise(text))
    return pages.groupBy("doc_id").agg(joined(F.collect_list(F.struct("page", section.alias("s"))), "s", "\n\n").alias("text"))


def clean_recognition(pages: DataFrame) -> DataFrame:
    """doc_id, page, text, confidence (whole, 0 to 100, or null), total_characters of the document, from
    ``pages(doc_id, page, seq, text, confidence)``; a missing page number is the row's place."""
    ok = F.col("confidence").isNotNull() & ~F.isnan("confidence") & (F.abs("confidence") < float("inf"))
    whole = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.col("confidence") + 0.5)))
    clean = pages.select("doc_id", F.coalesce("page", "seq").alias("page"), F.coalesce("text", F.lit("")).alias("text"), F.when(ok, whole).alias("confidence"))
    totals = clean.groupBy("doc_id").agg(F.sum(F.length("text")).alias("total_characters"))
    return clean.join(totals, "doc_id")


def pages_to_markdown(pages: DataFrame, breaks: bool = False) -> DataFrame:
    """doc_id, markdown: short lines of capitals become headings, bullets list items."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x != "")

    def shown(line: Column) -> Column:
        heading = (F.length(line) < 72) & line.rlike(rf"^(?:[A-Z0-9:&-]|{WS})+$")
        item = line.rlike("^[•*-]")
        return F.when(heading, F.concat(F.lit("## "), F.regexp_replace(line, f"{WS}+", " "))).when(item, F.concat(F.lit("- "), F.regexp_replace(line, f"^[•*-]{WS}*", ""))).otherwise(line)

    page = F.concat(F.lit("# Page "), F.col("page").cast("string"), F.lit("\n\n"), F.array_join(F.transform(lines, shown), "\n\n"))
    return pages.groupBy("doc_id").agg(joined(F.collect_list(F.struct("page", page.alias("s"))), "s", "\n\n---\n\n" if breaks else "\n\n").alias("markdown"))


def markdown_blocks(docs: DataFrame, max_characters: int = 250_000, max_blocks: int = 1_000) -> DataFrame:
    """doc_id, block (from 1), type, level, text, items, truncated of ``docs(doc_id, markdown)``.

    Lines are classed one by one; neighbours of one list type, and paragraph lines, form islands. A line that
    only looks like a block start without being one (a bare ``#``) begins a paragraph of its own.
    """
    source = unix_lines(F.coalesce("markdown", F.lit("")))
    lines = docs.select("doc_id", (F.length(source) > max_characters).alias("cut"), F.posexplode(F.split(F.left(source, F.lit(max_characters)), "\n", -1)).alias("at", "line"))
    kind = (
        F.when(trimmed(F.col("line")) == "", "blank").when(F.col("line").rlike(rf"^{WS}*#{{1,6}}{WS}+.+$"), "heading").when(F.col("line").rlike(rf"^{WS}*---+{WS}*$"), "divider")
        .when(F.col("line").rlike(rf"^{WS}*[-*+]{WS}+.+$"), "list").when(F.col("line").rlike(rf"^{WS}*[0-9]+[.)]{WS}+.+$"), "ordered-list").otherwise("paragraph")
    )
    starts_like = F.col("line").rlike(rf"^{WS}*(?:#{{1,6}}{WS}+|[-*+]{WS}+|[0-9]+[.)]{WS}+|---+{WS}*$)")
    order = Window.partitionBy("doc_id").orderBy("at")
    classed = lines.withColumn("type", kind).withColumn("was", F.lag("type").over(order)).withColumn("starts", starts_like)
    fresh = F.col("was").isNull() | (F.col("type") != F.col("was")) | F.col("type").isin("heading", "divider", "blank") | ((F.col("type") == "paragraph") & F.col("starts"))
    islands = classed.withColumn("island", F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = islands.filter("type <> 'blank'").groupBy("doc_id", "island", "type", "cut").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("rows"))
    first = F.col("rows")[0]["line"]
    texts = F.transform("rows", lambda r: r["line"])
    numbered = blocks.withColumn("block", F.row_number().over(Window.partitionBy("doc_id").orderBy("island"))).withColumn("total", F.count("*").over(Window.partitionBy("doc_id")))
    return numbered.filter(F.col("block") <= max_blocks).select(
        "doc_id",
        "block",
        "type",
        F.when(F.col("type") == "heading", F.length(F.regexp_extract(first, rf"^{WS}*(#{{1,6}}){WS}+", 1))).alias("level"),
        F.when(F.col("type") == "heading", F.regexp_extract(first, rf"^{WS}*#{{1,6}}{WS}+(.+)$", 1)).when(F.col("type") == "paragraph", F.array_join(texts, "\n")).alias("text"),
        F.when(F.col("type") == "list", F.transform(texts, lambda x: F.regexp_extract(x, rf"^{WS}*[-*+]{WS}+(.+)$", 1)))
        .when(F.col("type") == "ordered-list", F.transform(texts, lambda x: F.regexp_extract(x, rf"^{WS}*[0-9]+[.)]{WS}+(.+)$", 1)))
        .alias("items"),
        (F.col("cut") | (F.col("total") > max_blocks)).alias("truncated"),
    )


def chunk_text(docs: DataFrame, size: int = 3500) -> DataFrame:
    """doc_id, chunk (from 1), text: consecutive chunks of ``size`` code points; none of an empty text."""
    starts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / size).cast("int"))
    return docs.filter(F.length("text") > 0).select("doc_id", "text", F.explode(starts).alias("c")).select("doc_id", (F.col("c") + 1).alias("chunk"), F.substring("text", F.col("c") * size + 1, F.lit(size)).alias("text"))


def apply_glossary(docs: DataFrame, language: str, glossary: DataFrame | None = None, max_bytes: int = MAX_GLOSSARY) -> DataFrame:
    """doc_id, replacements, body: whole ASCII words of the glossary replaced, in any case; ``es`` where the
    language is unknown. A word ends where no ASCII letter, digit or underscore follows.

    ``glossary(language, term, replacement)`` takes the place of the built-in words. A term may be several words,
    which match with any white space between them; the longest term that begins at a word wins, and matches don't
    overlap. Of terms that are alike but for case the smallest replacement counts; rows with nulls, terms without a
    word and terms with signs between words don't. The terms of the language are broadcast if they have ``max_bytes``
    at most; else each document meets, by a join on their words, the terms whose first word it has.
    """
    if glossary is None:
        words = GLOSSARIES.get(language.lower(), GLOSSARIES["es"])
        table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
        tokens = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z0-9_]++|[^A-Za-z0-9_]++"), F.lit(0))
        known = F.filter(tokens, lambda t: F.lower(t).isin(*words))
        body = F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, F.lower(t)), t)), "")
        return docs.select("doc_id", F.size(known).alias("replacements"), body.alias("body"))
    term = F.lower(F.regexp_replace(trimmed(F.col("term")), f"{WS}+", " "))
    rows = glossary.select(F.lower("language").alias("language"), term.alias("term"), "replacement").filter(F.col("term").rlike("^[a-z0-9_]+(?: [a-z0-9_]+)*$") & F.col("replacement").isNotNull())
    own = rows.filter(F.col("language") == language.lower())
    own = own if own.limit(1).count() else rows.filter("language = 'es'")
    terms = own.groupBy("term").agg(F.min("replacement").alias("replacement"))
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + F.octet_length("replacement")), F.lit(0))).first()[0]
    kind, result = docs.schema["doc_id"].dataType.simpleString(), "replacements int, body string"
    if size <= max_bytes:
        sent = docs.sparkSession.sparkContext.broadcast(term_tree([(r["term"], r["replacement"]) for r in terms.collect()]))

        def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [replaced(t or "", sent.value) for t in batch["text"].to_pylist()]
                yield pa.record_batch([batch["doc_id"], pa.array([n for n, _ in found], pa.int32()), pa.array([t for _, t in found], pa.string())], ["doc_id", "replacements", "body"])

        return docs.select("doc_id", "text").mapInArrow(replace, f"doc_id {kind}, {result}")
    # Rows are told apart by their text as well, so that a repeated doc_id keeps its texts.
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.xxhash64("text"))
    first = keyed.select("digest", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0)))).alias("first")).distinct()
    met = first.join(terms.withColumn("first", F.substring_index("term", " ", 1)), "first").groupBy("digest").agg(F.collect_list(F.struct("term", "replacement")).alias("terms"))

    def replace_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [replaced(t, term_tree([(r["term"], r["replacement"]) for r in own or []])) for t, own in zip(batch["text"].to_pylist(), batch["terms"].to_pylist(), strict=True)]
            yield pa.record_batch([batch["doc_id"], pa.array([n for n, _ in found], pa.int32()), pa.array([t for _, t in found], pa.string())], ["doc_id", "replacements", "body"])

    return keyed.join(met, "digest", "left").select("doc_id", "text", "terms").mapInArrow(replace_own, f"doc_id {kind}, {result}")


def term_tree(terms: list[tuple[str, str]]) -> dict:
    """Terms word by word; what replaces a term stands under None."""
    tree: dict = {}
    for term, replacement in terms:
        node = tree
        for word in term.split(" "):
            node = node.setdefault(word, {})
        node[None] = replacement
    return tree


def replaced(text: str, tree: dict) -> tuple[int, str]:
    """How many terms of ``tree`` were replaced, and the text with them replaced."""
    words = [(m.start(), m.end(), m[0].lower()) for m in ASCII_WORD.finditer(text)]
    out, done, count, i = [], 0, 0, 0
    while i < len(words):
        node, k, best = tree.get(words[i][2]), i, None
        while node is not None:
            best = (k, node[None]) if None in node else best
            k += 1
            node = node.get(words[k][2]) if k < len(words) and GAP.fullmatch(text, words[k - 1][1], words[k][0]) else None
        if best:
            out += text[done : words[i][0]], best[1]
            i, done, count = best[0], words[best[0]][1], count + 1
        i += 1
    return count, "".join([*out, text[done:]])


def best_sentences(keys: list[str], lengths: list[int], most: int) -> list[int]:
    """Places of the ``most`` sentences with the most frequent words, ascending; of equal ``keys`` the first."""
    words = [[w for w in SUMMARY_WORD.findall(k) if w not in SUMMARY_STOP] for k in keys]
    counts = Counter(w for own in words for w in own)
    first = {k: i for i, k in reversed(list(enumerate(keys)))}
    score = lambda i: sum(counts[w] for w in words[i]) / max(8.0, sqrt(lengths[i]))
    return sorted(sorted(first.values(), key=lambda i: (-score(i), i))[:most])


def summarize(docs: DataFrame, sentences: int = 5, prose: bool = False) -> DataFrame:
    """doc_id, summary, n_sentences: the sentences with the most frequent words, in the text's order.

    Sentences that differ in case alone count once. All that a summary needs stands in its row, so no text is
    shuffled: built-in functions split it, one Python call counts its words and names the best sentences, built-in
    functions join them. Documents without a sentence have no row.
    """

    @F.arrow_udf("array<int>")
    def chosen(keys: pa.Array, lengths: pa.Array) -> pa.Array:
        return pa.array([best_sentences(k, n, sentences) for k, n in zip(keys.to_pylist(), lengths.to_pylist(), strict=True)], pa.list_(pa.int32()))

    # Not deterministic to the optimizer: it would split the text and call this again for the filter below.
    chosen = chosen.asNondeterministic()
    lines = F.split(unix_lines(F.coalesce("text", F.lit(""))), r"\n+", -1)
    found = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(trimmed(x), F.lit(r"[^.!?]+[.!?]+|[^.!?]+\z"), F.lit(0))))
    found = F.filter(F.transform(found, lambda s: trimmed(F.regexp_replace(s, f"{WS}+", " "))), lambda s: s != "")
    rows = docs.select("doc_id", found.alias("sentences"))
    rows = rows.withColumn("chosen", chosen(F.transform("sentences", F.lower), F.transform("sentences", F.length))).filter(F.size("chosen") > 0)
    line = lambda i: F.get("sentences", i) if prose else F.concat(F.lit("• "), F.get("sentences", i))
    return rows.select("doc_id", F.array_join(F.transform("chosen", line), " " if prose else "\n").alias("summary"), F.size("chosen").cast("long").alias("n_sentences"))


# Points of a page's height.
PAGE_HEIGHTS = {("a4", "portrait"): 841.89, ("a4", "landscape"): 595.28, ("letter", "portrait"): 792.0, ("letter", "landscape"): 612.0}


def paginate_lines(lines: DataFrame, size: str = "a4", orientation: str = "portrait") -> DataFrame:
    """``lines(doc_id, line, text)`` with the output page and the line's place on it."""
    per_page = int((PAGE_HEIGHTS[size, orientation] - 110) // 16) + 1
    return lines.select("doc_id", "line", F.ceil(F.col("line") / per_page).alias("page"), ((F.col("line") - 1) % per_page + 1).alias("line_on_page"), "text")


def filled(words: list[str], width: int) -> Iterator[str]:
    """Lines of at most ``width`` characters, filled greedily; longer words are broken."""
    line = ""
    for word in words:
        for at in range(0, len(word), width):
            piece = word[at : at + width]
            if line and len(line) + 1 + len(piece) > width:
                yield line
                line = piece
            else:
                line = f"{line} {piece}" if line else piece
    if line:
        yield line


def reflow(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, line, text: words filled greedily into lines of at most ``width`` characters; longer words are broken.

    Where a line ends depends on all before it, so each text's words, split by Spark, are gone through once."""
    words = F.filter(F.split(trimmed(F.coalesce("text", F.lit(""))), f"{WS}+", -1), lambda w: w != "")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, own in zip(batch["doc_id"], batch["words"].to_pylist(), strict=True):
                lines = list(filled(own, width))
                yield pa.record_batch([pa.repeat(doc, len(lines)), pa.array(range(1, len(lines) + 1), pa.int64()), pa.array(lines, pa.string())], ["doc_id", "line", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", words.alias("words")).mapInArrow(fill, f"doc_id {kind}, line long, text string")


def escape_html(text: Column) -> Column:
    for sign, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(sign), F.lit(to))
    return text
