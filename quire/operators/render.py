"""Blocks to bilingual HTML: markdown tables, allow-listed HTML tables, images as data URIs, one text for each document."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.functions import text as fx

# Tags and attributes that HTML tables keep.
TAGS = ("table", "thead", "tbody", "tfoot", "tr", "th", "td", "caption", "br", "sub", "sup", "em", "strong", "span", "p")
ATTRIBUTES = ("rowspan", "colspan", "scope")
# Texts of figures whose image is missing or can't be read.
NO_IMAGE, BAD_IMAGE = "图片资源缺失：", "图片资源读取失败："


def fallback(c: Column) -> Column:
    return F.concat(F.lit('<pre class="table-fallback">'), fx.escape_html(c), F.lit("</pre>"))


def markdown_table(c: Column) -> Column:
    """Header row, body rows, the rule between them dropped; escaped pipes stay in their cell."""
    rows = F.filter(F.split(c, "\n"), lambda x: fx.js_trim(x) != "")
    cells = lambda row: F.transform(F.split(F.regexp_replace(fx.js_trim(row), r"^\||\|\z", ""), r"(?<!\\)\|"), lambda x: fx.inline_markdown(F.replace(fx.js_trim(x), F.lit("\\|"), F.lit("|"))))
    line = lambda row, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(cells(row), lambda x: F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    body = F.array_join(F.transform(F.slice(rows, F.lit(3), F.greatest(F.size(rows) - 2, F.lit(0))), lambda r: line(r, "td")), "")
    table = F.concat(F.lit('<div class="table-wrap"><table><thead>'), line(F.get(rows, F.lit(0)), "th"), F.lit("</thead><tbody>"), body, F.lit("</tbody></table></div>"))
    return F.when(F.size(rows) < 2, fallback(c)).otherwise(table)


class _Keeper(HTMLParser):
    """Rebuilds markup from allowed tags and attributes; of anything else only the text stays."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in TAGS:
            kept = "".join(f' {k}="{html.escape(v or "")}"' for k, v in attrs if k in ATTRIBUTES)
            self.out.append(f"<{tag}{kept}>")

    def handle_endtag(self, tag):
        if tag in TAGS and tag != "br":
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        self.out.append(html.escape(data, quote=False))


def keep_table(markup: str) -> str:
    keeper = _Keeper()
    keeper.feed(markup)
    keeper.close()
    return f'<div class="table-wrap">{"".join(keeper.out)}</div>'


@F.pandas_udf(StringType())
def html_table(c: pd.Series) -> pd.Series:
    return c.map(lambda x: keep_table(x), na_action="ignore")


def render_table(c: Column) -> Column:
    return F.when(c.rlike(r"^\s*\|") | c.rlike(r"\n\s*\|?\s*:?-{3,}"), markdown_table(c)).when(c.rlike(r"(?i)^\s*<table[\s>]"), html_table(c)).otherwise(fallback(c))


def render_image(source: Column, asset_path: Column, shown_path: Column, block_id: Column, content: Column) -> Column:
    named = fx.escape_html(F.coalesce(F.nullif(shown_path, F.lit("")), block_id))
    missing = lambda why: F.concat(F.lit(f'<figure class="missing-asset"><div>{why}'), named, F.lit("</div></figure>"))
    caption = F.when(F.coalesce(source, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit('<figcaption><span class="en">'), fx.inline_markdown(source), F.lit("</span></figcaption>")))
    data = F.concat(F.lit("data:"), fx.media_type(asset_path), F.lit(";base64,"), F.regexp_replace(F.base64(content), "[\\r\\n]", ""))  # one line, however the session chunks it
    figure = F.concat(F.lit('<figure><img src="'), data, F.lit('" alt="'), fx.escape_html(F.coalesce(source, F.lit(""))), F.lit('" loading="lazy">'), caption, F.lit("</figure>"))
    return F.when(F.coalesce(asset_path, F.lit("")) == "", missing(NO_IMAGE)).when(content.isNull(), missing(BAD_IMAGE)).otherwise(figure)


def render_block(tables: bool = True) -> Column:
    """HTML of a row (id, type, source, translation, asset_path, source_asset_path, content); null for dropped blocks."""
    kind, src, rid = F.col("type"), F.col("source"), F.col("id")
    en, zh = fx.inline_markdown(src), fx.inline_markdown(fx.sanitize(F.coalesce("translation", F.lit(""))))
    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    pair = lambda tag, more="": cat(f'<{tag} class="bilingual-block{more}" data-block-id="', rid, '"><span class="en">', en, '</span><span class="zh">', zh, f"</span></{tag}>")
    two = lambda head, tail: cat(head, rid, '"><p class="en">', en, '</p><p class="zh">', zh, f"</p></{tail}>")
    table = render_table if tables else markdown_table
    out = F.when(kind == "title", pair("h1")).when(kind == "heading", pair("h2")).when(kind == "subheading", pair("h3")).when(kind == "caption", pair("p", " caption"))
    out = out.when(kind == "author", cat('<p class="byline" data-block-id="', rid, '">', en, "</p>")).when(kind == "reference", cat('<p class="reference en-always" data-block-id="', rid, '">', en, "</p>"))
    out = out.when(kind == "paragraph", two('<section class="pair" data-block-id="', "section")).when(kind == "quote", two('<blockquote data-block-id="', "blockquote"))
    out = out.when(kind == "formula", cat('<pre class="formula en-always" data-block-id="', rid, '">', fx.escape_html(src), "</pre>"))
    out = out.when(kind == "table", cat('<section class="table-pair" data-block-id="', rid, '"><div class="en">', table(src), '</div><div class="zh">', table(fx.sanitize(F.coalesce("translation", F.lit("")))), "</div></section>"))
    return out.when(kind == "image", render_image(src, F.col("asset_path"), F.col("source_asset_path"), rid, F.col("content")))


def render_bodies(blocks: DataFrame, assets: DataFrame | None = None, tables: bool = True) -> DataFrame:
    """doc_id, body: rendered blocks in order, joined by line breaks. ``assets`` is (asset_path, content)."""
    have = blocks
    for c in ("asset_path", "source_asset_path"):
        have = have if c in have.columns else have.withColumn(c, F.lit(None).cast("string"))
    have = have.join(assets, "asset_path", "left") if assets is not None else have.withColumn("content", F.lit(None).cast("binary"))
    parts = have.select("doc_id", "pos", render_block(tables).alias("h")).where("h is not null")
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "h"))), lambda x: x["h"]), "\n").alias("body"))


def fill_template(template: Column, title: Column, meta: Column, body: Column) -> Column:
    """Literal replacement of the title and meta marks everywhere and of the body mark."""
    c = F.replace(template, F.lit("{{TITLE}}"), fx.escape_html(title))
    c = F.replace(c, F.lit("{{META}}"), fx.escape_html(meta))
    return F.replace(c, F.lit("{{BODY}}"), body)
