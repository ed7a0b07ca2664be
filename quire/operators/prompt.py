"""Prompts: glossary sections, selection prompts and batch payloads. The wording of instructions is this library's own, but for the user text of a
selection, which is a fixed value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Terms in a glossary section and what stands for none; names of what is translated and of its context by level.
GLOSSARY_LINES, NO_TERMS = 40, "（无）"
LEVELS = {1: ("词", "所在句子"), 2: ("句子", "所在段落"), 3: ("段落", "上下文")}
SYSTEM = {
    1: "You explain how an academic term is used in its sentence and translate it briefly.",
    2: "You translate one sentence of a paper, true to its paragraph, then add short notes after a line of ---.",
    3: "You translate a passage of a paper, true to its context, then summarise it after a line of ---.",
}
WITH_ENTRY = "A dictionary entry is known already; say only what the context adds."


def glossary_lines(terms: Column) -> Column:
    """term → translation (field), one a line, of array<struct<term,translation,field>>."""
    line = lambda e: F.concat(e["term"], F.lit(" → "), e["translation"], F.when(F.coalesce(e["field"], F.lit("")) != "", F.concat(F.lit(" ("), e["field"], F.lit(")"))).otherwise(F.lit("")))
    return F.array_join(F.transform(terms, line), "\n")


def paper_glossary(terms: Column) -> Column:
    """term → translation（note）, the first lines only, or the stand-in for none."""
    line = lambda e: F.concat(e["term"], F.lit(" → "), e["translation"], F.when(F.coalesce(e["note"], F.lit("")) != "", F.concat(F.lit("（"), e["note"], F.lit("）"))).otherwise(F.lit("")))
    return F.when(F.coalesce(F.size(terms), F.lit(0)) <= 0, F.lit(NO_TERMS)).otherwise(F.array_join(F.transform(F.slice(terms, 1, GLOSSARY_LINES), line), "\n"))


def _by_level(level: Column, values: dict) -> Column:
    return F.when(level == 1, F.lit(values[1])).when(level == 3, F.lit(values[3])).otherwise(F.lit(values[2]))


def selection_prompt(rows: DataFrame) -> DataFrame:
    """Adds messages (array<struct<role,content>>) to (level, selected, context, target_language, has_dict, terms)."""
    level = F.col("level")
    what, where = (_by_level(level, {k: v[i] for k, v in LEVELS.items()}) for i in (0, 1))
    system = F.concat(_by_level(level, SYSTEM), F.when((level == 1) & F.col("has_dict"), F.lit(f" {WITH_ENTRY}")).otherwise(F.lit("")))
    section = F.when(F.coalesce(F.size("terms"), F.lit(0)) > 0, F.concat(F.lit("\n\n【术语参考】\n"), glossary_lines(F.col("terms")))).otherwise(F.lit(""))
    # Fixed value: the user text of a selection.
    user = F.concat(F.lit("请将以下"), what, F.lit("翻译成 "), "target_language", F.lit("。\n\n【待翻译"), what, F.lit("】\n"), "selected", F.lit("\n\n【"), where, F.lit("】\n"), "context", section)
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return rows.withColumn("messages", F.array(message("system", system), message("user", user)))


def batch_payloads(blocks: DataFrame) -> DataFrame:
    """doc_id, batch_no, json, text of (doc_id, batch_no, pos, id, type, source): both protocols' payloads, in block order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "id", "type", "source")))
    lists = blocks.groupBy("doc_id", "batch_no").agg(ordered.alias("b"))
    as_json = F.to_json(F.transform("b", lambda x: F.struct(x["id"].alias("id"), x["type"].alias("type"), x["source"].alias("source"))))
    as_text = F.array_join(F.transform("b", lambda x: F.concat(F.lit("@@"), x["id"], F.lit("\n"), x["source"])), "\n\n")
    return lists.select("doc_id", "batch_no", as_json.alias("json"), as_text.alias("text"))


def glossary_sample(blocks: DataFrame, most: int = 30, chars: int = 12_000) -> DataFrame:
    """doc_id, sample: the first translatable sources joined by blank lines, cut."""
    from quire.functions.text import is_translatable

    own = blocks.where(is_translatable(F.col("type")))
    parts = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "source"))), lambda x: x["source"]), 1, most)
    return own.groupBy("doc_id").agg(F.substring(F.array_join(parts, "\n\n"), 1, chars).alias("sample"))
