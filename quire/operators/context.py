"""Context of a text selection: level, first matching paragraph and sentence, neighbours, pages stitched across their borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import context_level, js_trim, split_sentences

# Labels of the neighbours in a paragraph context.
BEFORE, HERE, AFTER = "[前一段] ", "[选中段] ", "[后一段] "


def first_containing(parts: Column, selected: Column) -> Column:
    """Index from 0 of the first part that holds the selection (trimmed, either case), else -1."""
    wanted = F.lower(js_trim(selected))
    return (F.array_position(F.transform(parts, lambda p: F.instr(F.lower(p), wanted) > 0), F.lit(True)) - 1).cast("int")


def neighbour_text(parts: Column, at: Column) -> Column:
    side = lambda label, i: F.concat(F.lit(label), F.when(i >= 0, F.get(parts, i)))
    return F.when(at < 0, F.lit("")).otherwise(F.concat_ws("\n\n", side(BEFORE, at - 1), side(HERE, at), side(AFTER, at + 1)))


def resolve_context(selections: DataFrame, selected: str = "selected", paragraphs: str = "paragraphs") -> DataFrame:
    """Adds level, paragraph_index (null for a word) and context: the sentence, or the paragraph with its neighbours."""
    s, p = F.col(selected), F.col(paragraphs)
    at = first_containing(p, s)
    step = selections.withColumn("level", context_level(s)).withColumn("_at", at)
    own = F.get(p, F.col("_at"))
    sentences = split_sentences(own)
    hit = first_containing(sentences, s)
    sentence = F.when(F.col("_at") < 0, F.lit("")).otherwise(F.coalesce(F.when(hit >= 0, F.get(sentences, hit)), own))
    context = F.when(F.col("level") == 3, neighbour_text(p, F.col("_at"))).otherwise(sentence)
    return step.withColumn("context", context).withColumn("paragraph_index", F.when(F.col("level") > 1, F.col("_at"))).drop("_at")


def neighbours(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, pos, text) with the labelled context of every paragraph, by window rather than by array."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    return paragraphs.withColumn("context", F.concat_ws("\n\n", F.concat(F.lit(BEFORE), F.lag("text").over(w)), F.concat(F.lit(HERE), "text"), F.concat(F.lit(AFTER), F.lead("text").over(w))))


def stitch_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page, paragraphs) with an unfinished last paragraph continued by the next page's first, and a first one that doesn't
    start with a capital preceded by the previous page's last. Neighbours are taken as they were before stitching."""
    w = Window.partitionBy("doc_id").orderBy("page")
    own = F.col("paragraphs")
    near = (
        pages.withColumn("_next", F.when(F.lead("page").over(w) == F.col("page") + 1, F.get(F.lead("paragraphs").over(w), F.lit(0))))
        .withColumn("_prev", F.when((F.lag("page").over(w) == F.col("page") - 1) & (F.col("page") > 1), F.try_element_at(F.lag("paragraphs").over(w), F.lit(-1))))
        .withColumn("_n", F.size(own))
    )
    last = F.get(own, F.col("_n") - 1)
    more = F.col("_next").isNotNull() & ~js_trim(last).rlike(r"[.?!]\z")
    ended = F.when(more, F.concat(F.slice(own, F.lit(1), F.col("_n") - 1), F.array(F.concat(last, F.lit(" "), F.col("_next"))))).otherwise(own)
    step = near.where("_n > 0").withColumn("_ended", ended)
    first = F.get("_ended", F.lit(0))
    before = F.col("_prev").isNotNull() & ~js_trim(first).rlike("^[A-Z]")
    begun = F.when(before, F.concat(F.array(F.concat(F.col("_prev"), F.lit(" "), first)), F.slice("_ended", F.lit(2), F.greatest(F.col("_n") - 1, F.lit(0))))).otherwise(F.col("_ended"))
    out = step.withColumn("paragraphs", begun).select(*pages.columns)
    return out.unionByName(near.where("_n <= 0 or _n is null").select(*pages.columns))
