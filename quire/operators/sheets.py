"""Tables rebuilt from text lines, and workbooks as cell rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import joined, trimmed


def lines_to_cells(pages: DataFrame) -> DataFrame:
    """doc_id, page, row (from 1), col (from 1), value: a line's cells stand apart by two blanks, a tab or a bar;
    a blank page has no rows."""
    text = F.coalesce("text", F.lit(""))
    rows = pages.filter(trimmed(text) != "").select("doc_id", "page", F.posexplode(F.split(text, "\n", -1)).alias("row", "line"))
    return rows.select("doc_id", "page", (F.col("row") + 1).alias("row"), F.posexplode(F.transform(F.split("line", r"\s{2,}|\t|\|", -1), trimmed)).alias("c", "value")).select("doc_id", "page", "row", (F.col("c") + 1).alias("col"), "value")


def sheet_plan(pages: DataFrame, max_rows: int = 8, max_columns: int = 6) -> DataFrame:
    """doc_id, page, name, rows, n_values, columns, cut_rows, cut_columns of every page; empty pages count."""
    cells = lines_to_cells(pages).groupBy("doc_id", "page").agg(F.max("row").alias("rows"), F.count_if(F.col("value") != "").alias("n_values"), F.max("col").alias("columns"))
    all_pages = pages.select("doc_id", "page").join(cells, ["doc_id", "page"], "left").na.fill(0, ["rows", "n_values", "columns"])
    return all_pages.select("doc_id", "page", F.concat(F.lit("Page "), F.col("page").cast("string")).alias("name"), "rows", "n_values", "columns", (F.col("rows") > max_rows).alias("cut_rows"), (F.col("columns") > max_columns).alias("cut_columns"))


def workbook_stats(cells: DataFrame) -> DataFrame:
    """Of ``cells(doc_id, sheet_no, sheet, row, col, value)`` (row and col from 0): used range and values of each
    sheet, and a row a workbook (sheet_no null) with the sums."""
    sheets = cells.groupBy("doc_id", "sheet_no").agg(
        (F.min("row") + 1).alias("start_row"),
        F.min("col").alias("start_column"),
        (F.max("row") - F.min("row") + 1).alias("n_rows"),
        (F.max("col") - F.min("col") + 1).alias("n_columns"),
        F.count_if(trimmed(F.coalesce("value", F.lit(""))) != "").alias("n_values"),
    )
    sheets = sheets.withColumn("slots", F.col("n_rows") * F.col("n_columns"))
    out = sheets.rollup("doc_id", "sheet_no").agg(
        *[F.when(F.grouping("sheet_no") == 0, F.max(c)).alias(c) for c in ("start_row", "start_column", "n_rows", "n_columns")],
        F.sum("slots").alias("slots"), F.sum("n_values").alias("n_values"), F.count("*").alias("sheets"), F.count_if(F.col("n_values") > 0).alias("sheets_with_values"), F.grouping("doc_id").alias("g"),
    )
    return out.filter("g = 0").drop("g")


#: Fixed value: the used ranges of one workbook may cover so many cells.
MAX_SLOTS = 10_000_000
BETWEEN = "  |  "


def workbook_text(cells: DataFrame, max_slots: int = MAX_SLOTS) -> DataFrame:
    """doc_id, text, error_code: sheets in order, each its name and its rows from the first used one, cells from the
    first used column, those that are missing empty.

    A gap is as many separators as it is wide, so that work and rows follow the cells there are, however far they
    stand apart. A workbook whose used ranges cover more than ``max_slots`` cells has a code and no text.
    """
    text = F.replace(F.coalesce("value", F.lit("")), F.lit("\0"), F.lit(""))
    sheet, row = Window.partitionBy("doc_id", "sheet_no", "sheet"), Window.partitionBy("doc_id", "sheet_no", "sheet", "row")
    span = lambda c: F.max(c).over(sheet) - F.min(c).over(sheet) + 1
    placed = cells.select("doc_id", "sheet_no", "sheet", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), text.alias("value"))
    placed = placed.withColumn("slots", span("row") * span("col")).withColumn("gap", F.col("col") - F.coalesce(F.lag("col").over(row.orderBy("col")), F.min("col").over(sheet)))
    fits = F.col("slots") <= max_slots
    gap = lambda sign, n: F.repeat(F.lit(sign), F.when(fits, n).otherwise(0).cast("int"))
    lines = placed.groupBy("doc_id", "sheet_no", "sheet", "slots", "row").agg(joined(F.collect_list(F.struct("col", F.concat(gap(BETWEEN, F.col("gap")), "value").alias("s"))), "s", "").alias("line"))
    above = F.col("row") - F.coalesce(F.lag("row").over(sheet.orderBy("row")), F.col("row"))
    lines = lines.withColumn("line", F.concat(gap("\n", above), "line"))
    sheets = lines.groupBy("doc_id", "sheet_no", "sheet", "slots").agg(joined(F.collect_list(F.struct("row", F.col("line").alias("s"))), "s", "").alias("body"))
    books = sheets.groupBy("doc_id").agg(F.sum("slots").alias("slots"), joined(F.collect_list(F.struct("sheet_no", F.concat_ws("\n", "sheet", "body").alias("s"))), "s", "\n\n").alias("text"))
    return books.select("doc_id", F.when(fits, F.col("text")).alias("text"), F.when(~fits, "spreadsheet-cell-limit").alias("error_code"))


def cell_preview(cells: DataFrame, rows: int = 8, columns: int = 6, characters: int = 96) -> DataFrame:
    """The first cells of each sheet's used range, long values cut with an ellipsis."""
    sheet = Window.partitionBy("doc_id", "sheet_no")
    text = F.replace(F.coalesce("value", F.lit("")), F.lit("\0"), F.lit(""))
    shown = F.when(F.length(text) > characters, F.concat(F.left(text, F.lit(characters - 1)), F.lit("…"))).otherwise(text)
    placed = cells.select("doc_id", "sheet_no", (F.col("row") - F.min("row").over(sheet) + 1).alias("row"), (F.col("col") - F.min("col").over(sheet) + 1).alias("col"), shown.alias("value"))
    return placed.filter((F.col("row") <= rows) & (F.col("col") <= columns))
