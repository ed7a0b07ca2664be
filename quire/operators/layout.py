"""Positioned text items to columns, lines and paragraphs.

Items are (doc_id, page, ord, str, x, y, width, height). Everything but the line anchors is a window or a grouped
aggregate; a line's anchor depends on earlier decisions and is a fold over one page's sorted items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import js_round

# Width of an x bucket, least share of a bucket, least distance of two columns, gap of a new paragraph in line heights.
BUCKET, SHARE, APART, GAP = 20, 0.15, 100, 1.5
PAGE = ["doc_id", "page"]


def _with_columns(items: DataFrame) -> DataFrame:
    """Adds columns (of the page), all by windows over one partitioning by page."""
    page = Window.partitionBy(*PAGE)
    marked = (
        items.withColumn("_b", (F.floor(js_round(F.col("x")) / BUCKET + F.lit(0.5)) * BUCKET).cast("bigint"))
        .withColumn("_total", F.count(F.lit(1)).over(page)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*PAGE, "_b")))
        .withColumn("_kept", F.when(F.col("_n") >= F.col("_total") * F.lit(SHARE), F.col("_b")))
        .withColumn("_first", F.min("_kept").over(page)).withColumn("_second", F.min(F.when(F.col("_kept") > F.col("_first"), F.col("_kept"))).over(page))
    )
    two = (F.col("_total") >= 4) & F.coalesce(F.col("_second") - F.col("_first") > APART, F.lit(False))
    return marked.withColumn("columns", F.when(two, 2).otherwise(1)).drop("_b", "_total", "_n", "_kept", "_first", "_second")


def detect_columns(items: DataFrame) -> DataFrame:
    """doc_id, page, columns (1 or 2): the first two x buckets with at least 15 % of the items are over 100 apart."""
    return _with_columns(items.select(*PAGE, "x")).groupBy(*PAGE).agg(F.max("columns").alias("columns"))


def assign_columns(items: DataFrame) -> DataFrame:
    """Adds col_no: 0, or 0 and 1 left and right of the middle of a two-column page."""
    page = Window.partitionBy(*PAGE)
    middle = (F.min("x").over(page) + F.max("x").over(page)) / 2
    wide = _with_columns(items).withColumn("_mid", middle)
    return wide.withColumn("col_no", F.when((F.col("columns") == 2) & (F.col("x") >= F.col("_mid")), 1).otherwise(0)).drop("_mid", "columns")


def group_lines(items: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, line_no (from 0) and items (structs from the top, by x): an item joins the line whose first item's y is nearer than
    half its own height. The list of a page holds the whole items, so nothing is joined back."""
    keys = keys or PAGE
    lists = items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("ny"), "x", "ord", "height", "str"))).alias("all"))
    zero = F.struct(F.lit(None).cast("double").alias("y"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("starts"))

    def step(acc, it):
        y = -it["ny"]
        joins = F.coalesce(F.abs(y - acc["y"]) < it["height"] * 0.5, F.lit(False))
        return F.struct(F.when(joins, acc["y"]).otherwise(y).alias("y"), (acc["i"] + 1).alias("i"), F.when(joins, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["i"]))).alias("starts"))

    starts = lists.select(*keys, "all", F.aggregate("all", zero, step)["starts"].alias("starts"))
    each = starts.select(*keys, "all", "starts", F.posexplode("starts").alias("line_no", "start"))
    end = F.coalesce(F.get("starts", F.col("line_no") + 1), F.size("all"))
    return each.select(*keys, "line_no", F.slice("all", F.col("start") + 1, end - F.col("start")).alias("items"))


def lines(items: DataFrame) -> DataFrame:
    """doc_id, page, col_no, line_no, y (of the first item), height (largest), text (items by x, joined without separator)."""
    keys = [*PAGE, "col_no"]
    by_x = F.array_sort(F.transform("items", lambda i: F.struct(i["x"].alias("x"), i["ord"].alias("ord"), i["str"].alias("str"))))
    text = F.array_join(F.transform(by_x, lambda i: i["str"]), "")
    return group_lines(assign_columns(items), keys).select(*keys, "line_no", (-F.get("items", F.lit(0))["ny"]).alias("y"), F.array_max(F.transform("items", lambda i: i["height"])).alias("height"), text.alias("text"))


def paragraphs(items: DataFrame) -> DataFrame:
    """doc_id, page, col_no, par_no, text: a gap over 1.5 times the column's mean line height starts a paragraph."""
    keys = [*PAGE, "col_no"]
    w = Window.partitionBy(*keys)
    by_line = w.orderBy("line_no")
    gap = F.coalesce(F.lag("y").over(by_line) - F.col("y") > F.avg("height").over(w) * GAP, F.lit(False)).cast("int")
    marked = lines(items).withColumn("_new", gap).withColumn("par_no", F.sum("_new").over(by_line))
    parts = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda p: p["text"]), lambda x: x != "")
    return marked.groupBy(*keys, "par_no").agg(F.array_join(parts, " ").alias("text"))


def page_text(items: DataFrame) -> DataFrame:
    """doc_id, page, paragraphs, raw_text (paragraphs joined by line breaks), columns left first."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("col_no", "par_no", "text"))), lambda p: p["text"])
    return paragraphs(items).groupBy(*PAGE).agg(ordered.alias("paragraphs")).withColumn("raw_text", F.array_join("paragraphs", "\n"))
