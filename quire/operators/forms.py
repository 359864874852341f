"""Form values against field descriptors, and redaction regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import round_half_up


def parse_form_values(rows: DataFrame) -> DataFrame:
    """doc_id, name, kind, value_json, error_code of ``rows(doc_id, values)``: a row a key of a JSON object.

    kind is text, boolean, list or null. Null and empty input has no row; what isn't an object, an empty key,
    or a value of another kind gives its row a code.
    """
    given = rows.filter(F.length("values") > 0).select("doc_id", F.try_parse_json("values").alias("v"))
    is_object = F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False))
    wrong = given.filter(F.col("v").isNull() | ~is_object).select("doc_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("value_json"), F.lit("invalid-form-values").alias("error_code"))
    objects = given.filter(F.col("v").isNotNull() & is_object)
    entries = objects.lateralJoin(given.sparkSession.tvf.variant_explode(F.col("v").outer()))
    keys = entries.select("doc_id", F.col("key").alias("name"), F.schema_of_variant("value").alias("type"), F.to_json("value").alias("value_json"))
    kind = F.when(F.col("type") == "STRING", "text").when(F.col("type") == "BOOLEAN", "boolean").when(F.col("type").isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.col("value_json").rlike(r"^\[null|,null"), "list").when(F.col("type") == "VOID", "null")
    code = F.when(F.col("name") == "", "empty-field-name").when(kind.isNull(), "unsupported-form-value")
    return keys.select("doc_id", "name", kind.alias("kind"), "value_json", code.alias("error_code")).unionByName(wrong)


def choices(kind: str = "kind", value: str = "value_json"):
    return F.when(F.col(kind) == "text", F.array(F.from_json(F.concat(F.lit('{"a":'), F.col(value), F.lit("}")), "a string")["a"])).when(F.col(kind) == "list", F.from_json(value, "array<string>"))


def validate_form(values: DataFrame, fields: DataFrame) -> DataFrame:
    """doc_id, changes, valid, first_field, error_code of ``values(doc_id, name, kind, value_json)`` against
    ``fields(doc_id, name, type, supported, read_only, max_length, options)``; the first field by name that is
    wrong decides."""
    t, k, picked = F.col("type"), F.col("kind"), choices()
    text = F.try_element_at(picked, F.lit(1))
    fits = (
        F.when(t == "text", k == "text").when(t == "checkbox", k == "boolean").when(t.isin("dropdown", "radio"), k == "text").when(t == "option-list", k.isin("text", "list")).otherwise(True)
    )
    code = (
        F.when(t.isNull(), "field-not-found").when(F.col("read_only"), "read-only-field").when(~F.col("supported"), "unsupported-field").when(k == "null", None).when(~fits, "type-mismatch")
        .when(t.isin("dropdown", "radio", "option-list") & (F.size(F.array_except(picked, F.coalesce("options", F.array()))) > 0), "unknown-choice")
        .when((t == "text") & (F.col("max_length") > 0) & (F.length(text) > F.col("max_length")), "value-too-long")
    )
    checked = values.filter("name IS NOT NULL").join(fields, ["doc_id", "name"], "left").withColumn("code", code)
    facts = checked.groupBy("doc_id").agg(F.count("*").alias("changes"), F.min(F.when(F.col("code").isNotNull(), F.struct("name", "code"))).alias("bad"))
    return facts.select("doc_id", F.when(F.col("bad").isNull(), F.col("changes")).otherwise(0).alias("changes"), F.col("bad").isNull().alias("valid"), F.col("bad.name").alias("first_field"), F.col("bad.code").alias("error_code"))


def apply_form_values(fields: DataFrame, values: DataFrame) -> DataFrame:
    """doc_id, name, value_json, changed: named fields take their value, null clears a text to empty and a
    checkbox to false, all others stay."""
    given = values.filter("name IS NOT NULL").select("doc_id", "name", F.col("value_json").alias("new"), F.col("kind").alias("new_kind"))
    cleared = F.when(F.col("type") == "checkbox", "false").when(F.col("type") == "option-list", "[]").otherwise('""')
    value = F.when(F.col("new_kind") == "null", cleared).when(F.col("new_kind").isNotNull(), F.col("new")).otherwise(F.col("current_json"))
    return fields.join(given, ["doc_id", "name"], "left").select("doc_id", "name", value.alias("value_json"), F.col("new_kind").isNotNull().alias("changed"))


def form_stats(fields: DataFrame) -> DataFrame:
    """doc_id, fields, options, longest_name, longest_value, most_options, characters."""
    options = F.coalesce("options", F.array().cast("array<string>"))
    lengths = F.transform(options, lambda o: F.length(o))
    longest = F.greatest(F.coalesce(F.length("current_json"), F.lit(0)), F.coalesce(F.array_max(lengths), F.lit(0)))
    total = F.length("name") + F.coalesce(F.length("current_json"), F.lit(0)) + F.aggregate(lengths, F.lit(0), lambda a, x: a + x)
    return fields.groupBy("doc_id").agg(F.count("*").alias("fields"), F.sum(F.size(options)).alias("options"), F.max(F.length("name")).alias("longest_name"), F.max(longest).alias("longest_value"), F.max(F.size(options)).alias("most_options"), F.sum(total).alias("characters"))


LEAST = 0.5


def two_places(x):
    return F.floor(x * 100 + 0.5) / 100


def parse_regions(rows: DataFrame, max_regions: int | None = None, max_per_page: int | None = None) -> DataFrame:
    """doc_id, ord, page, x, y, width, height, error_code of ``rows(doc_id, regions, pages)``: a JSON array of
    rectangles in percent, rounded to two places. Input that is no array has one row with a code."""
    schema = "array<struct<page:double,x:double,y:double,width:double,height:double>>"
    blank = F.coalesce(F.trim("regions"), F.lit("")) == ""
    parsed = rows.withColumn("v", F.when(~blank, F.try_parse_json("regions"))).withColumn("list", F.when(F.schema_of_variant("v").startswith("ARRAY"), F.from_json("regions", schema)))
    bad = parsed.filter(~blank & F.col("list").isNull()).select("doc_id", F.when(F.col("v").isNull(), "invalid-redaction-json").otherwise("invalid-redaction-list").alias("error_code"))
    if max_regions is not None:
        bad = bad.unionByName(parsed.filter(F.size("list") > max_regions).select("doc_id", F.lit("too-many-redaction-regions").alias("error_code")))
        parsed = parsed.filter((F.size("list") <= max_regions) | F.col("list").isNull())
    items = parsed.select("doc_id", "pages", F.posexplode("list").alias("at", "r")).select("doc_id", "pages", (F.col("at") + 1).alias("ord"), F.col("r.page").alias("page"), *[two_places(F.col(f"r.{c}")).alias(c) for c in ("x", "y", "width", "height")])
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    code = (
        F.when(F.col("page").isNull() | (F.col("page") != F.floor("page")) | ~F.col("page").between(1, F.col("pages")), "invalid-redaction-page")
        .when(x.isNull() | y.isNull() | w.isNull() | h.isNull(), "invalid-redaction-coordinate")
        .when((x < 0) | (y < 0) | (w < LEAST) | (h < LEAST) | (x + w > 100) | (y + h > 100), "redaction-region-out-of-bounds")
    )
    if max_per_page is not None:
        code = code.when(F.count("*").over(Window.partitionBy("doc_id", "page").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)) > max_per_page, "too-many-page-redactions")
    return items.select("doc_id", "ord", F.col("page").cast("int").alias("page"), "x", "y", "width", "height", code.alias("error_code")).unionByName(bad, allowMissingColumns=True)


def region_plan(regions: DataFrame) -> DataFrame:
    """doc_id, regions, pages, page_list of the valid regions."""
    good = regions.filter("error_code IS NULL").groupBy("doc_id")
    return good.agg(F.count("*").alias("regions"), F.countDistinct("page").alias("pages"), F.array_join(F.array_sort(F.collect_set("page")).cast("array<string>"), ",").alias("page_list"))


def clamp_regions(regions: DataFrame) -> DataFrame:
    """``regions(doc_id, ord, page, x, y, width, height)`` moved and cut to lie on their page."""
    size = lambda c: F.greatest(F.lit(LEAST), F.least(F.lit(100.0), F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(LEAST))))
    place = lambda c, w: two_places(F.greatest(F.lit(0.0), F.least(100 - size(w), F.coalesce(F.col(c), F.lit(0.0)))))
    page = F.greatest(F.lit(1), round_half_up(F.coalesce(F.nullif(F.col("page").cast("double"), F.lit(0.0)), F.lit(1.0))))
    return regions.select("doc_id", "ord", page.alias("page"), place("x", "width").alias("x"), place("y", "height").alias("y"), two_places(size("width")).alias("width"), two_places(size("height")).alias("height"))


#: Pages are cut into tiles of so many hundredths of their width and height.
TILE = 5.0


def tile(x: Column) -> Column:
    """The tile of a place in percent; all places outside the page on one side share one."""
    return F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(100.0 / TILE), x / TILE))).cast("int")


#: Pages of at most so many regions have their cells compared with each of them.
FEW_REGIONS = 32


def mask_regions(cells: DataFrame, regions: DataFrame, fill: int = 0) -> DataFrame:
    """``cells(doc_id, page, x, y, value)`` (x and y in percent) with value ``fill`` and masked where a region of the
    page covers them.

    A page of few regions has them in one row, which its cells join. Where a page has more, regions and cells meet by
    page and tile: a tile that a region covers whole masks its cells at once, and only regions that cover part of it
    are compared with them. A cell joins one row of each kind at most, so it counts once. Both joins are by merging:
    rows of regions are much larger than their shuffle files let expect, so none of them is broadcast.
    """
    x, y = F.col("x"), F.col("y")
    covers = lambda areas: F.exists(areas, lambda r: (x >= r["x"]) & (x < r["x"] + r["width"]) & (y >= r["y"]) & (y < r["y"] + r["height"]))
    good = regions.filter("error_code IS NULL AND width > 0 AND height > 0").select("doc_id", "page", "x", "y", "width", "height")
    counted = good.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "page")))
    few = F.collect_list(F.when(F.col("n") <= FEW_REGIONS, F.struct("x", "y", "width", "height")))
    pages = counted.groupBy("doc_id", "page").agg(few.alias("areas"), F.max("n").alias("n"))
    met = cells.join(pages.hint("merge"), ["doc_id", "page"], "left").select(*cells.columns, F.coalesce(covers("areas"), F.lit(False)).alias("masked"), F.coalesce(F.col("n") > FEW_REGIONS, F.lit(False)).alias("crowded"))

    across, down = (F.sequence(tile(F.col(at)), tile(F.col(at) + F.col(size))) for at, size in (("x", "width"), ("y", "height")))
    tiles = counted.filter(F.col("n") > FEW_REGIONS).drop("n").select("*", F.explode(across).alias("tx"))
    tiles = tiles.select("*", F.explode(down).alias("ty"))
    inside = lambda t, at, size: (F.col(t) >= 0) & (F.col(t) < 100 / TILE) & (F.col(at) <= F.col(t) * TILE) & (F.col(at) + F.col(size) >= (F.col(t) + 1) * TILE)
    whole = inside("tx", "x", "width") & inside("ty", "y", "height")
    tiles = tiles.groupBy("doc_id", "page", "tx", "ty").agg(F.bool_or(whole).alias("whole"), F.collect_set(F.when(~whole, F.struct("x", "y", "width", "height"))).alias("areas"))
    crowded = met.filter("crowded").drop("masked").withColumns({"tx": tile(x), "ty": tile(y)}).join(tiles.hint("merge"), ["doc_id", "page", "tx", "ty"], "left")
    crowded = crowded.select(*cells.columns, F.coalesce(F.col("whole") | covers("areas"), F.lit(False)).alias("masked"))

    value = F.when(F.col("masked"), F.lit(fill).cast(cells.schema["value"].dataType)).otherwise(F.col("value"))
    out = met.filter("NOT crowded").drop("crowded").unionByName(crowded)
    return out.select(*[value.alias(c) if c == "value" else F.col(c) for c in cells.columns], "masked")
