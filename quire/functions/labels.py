"""Labels and text projections of jobs, history records, lookups and storage paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import blank_to_null, js_trim, safe_directory

# Shown names of stages, operations and levels, and section heads of a record's details.
STAGE_NAMES = {
    "queued": "等待/恢复", "extracting": "解析 PDF", "structuring": "识别结构", "terminology": "生成术语", "translating": "翻译正文", "validating": "校验译文", "rendering": "渲染 HTML",
    "attaching": "保存附件", "completed": "已完成", "paused": "已暂停", "cancelled": "已取消", "failed": "失败",
}
OPERATION_NAMES = {"lookup": "查词", "phrase-translation": "短语翻译", "translation": "翻译"}
LEVEL_NAMES = {1: "查词", 2: "句子翻译", 3: "段落翻译"}
OTHER_NAME = "翻译"
CONTEXT_HEAD, DICTIONARY_HEAD, LOOKUP_HEAD, RESULT_HEAD = "上下文", "本地词典", "语境解释", "翻译结果"
# How long a selection stays fresh (milliseconds), default and other word lookup mode, default trigger.
FRESH_MS, LOOKUP_MODES, TRIGGER = 120_000, ("dictionary-context", "dictionary-only"), "contextmenu"


def _named(c: Column, names: dict, other: Column) -> Column:
    out = other
    for k, v in names.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def stage_label(stage: Column) -> Column:
    return _named(stage, STAGE_NAMES, F.lit(None).cast("string"))


def record_label(operation: Column, level: Column) -> Column:
    """The operation's name, else the level's, else the general one."""
    return _named(operation, OPERATION_NAMES, _named(level, LEVEL_NAMES, F.lit(OTHER_NAME)))


def dictionary_text(selected: Column, entry: Column) -> Column:
    """selected /phonetic/ over "pos translation"; null without an entry (struct phonetic, translation, pos)."""
    sound = F.when(F.coalesce(entry["phonetic"], F.lit("")) != "", F.concat(F.lit(" /"), entry["phonetic"], F.lit("/"))).otherwise(F.lit(""))
    kind = F.when(F.coalesce(entry["pos"], F.lit("")) != "", F.concat(entry["pos"], F.lit(" "))).otherwise(F.lit(""))
    return F.when(entry.isNotNull(), F.concat(selected, sound, F.lit("\n"), kind, F.coalesce(entry["translation"], F.lit(""))))


def result_text(selected: Column, entry: Column, result: Column) -> Column:
    """Dictionary line and result, blank parts left out, parted by a blank line (also the text of a lookup)."""
    return F.concat_ws("\n\n", dictionary_text(selected, entry), blank_to_null(result))


def details_text(selected: Column, context: Column, entry: Column, result: Column, operation: Column) -> Column:
    head = F.when(operation == "lookup", F.lit(LOOKUP_HEAD)).otherwise(F.lit(RESULT_HEAD))
    shown = F.when(js_trim(F.coalesce(result, F.lit(""))) != "", F.concat(head, F.lit("\n"), result))
    return F.concat_ws("\n\n", F.concat(F.lit(f"{CONTEXT_HEAD}\n"), F.coalesce(context, F.lit(""))), F.concat(F.lit(f"{DICTIONARY_HEAD}\n"), dictionary_text(selected, entry)), shown)


def asked_level(action: Column, level: Column) -> Column:
    """Lookup asks for a word, translate for a sentence at least; the context was chosen by the natural level before."""
    return F.when(action == "lookup", 1).when((action == "translate") & (level == 1), 2).otherwise(level)


def lookup_mode(c: Column) -> Column:
    return F.when(c == LOOKUP_MODES[1], F.lit(LOOKUP_MODES[1])).otherwise(F.lit(LOOKUP_MODES[0]))


def trigger_mode(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(TRIGGER))


def is_fresh(captured_ms: Column, now_ms: Column, same_reader: Column) -> Column:
    return same_reader & (now_ms - captured_ms <= FRESH_MS)


def is_work_item(is_regular: Column, is_pdf: Column) -> Column:
    return F.coalesce(is_regular, F.lit(False)) | F.coalesce(is_pdf, F.lit(False))


def utc_millis(stamp: Column) -> Column:
    """Epoch milliseconds of a "YYYY-MM-DD HH:MM:SS" text in UTC; null if it isn't one."""
    return F.unix_millis(F.try_to_timestamp(F.concat(stamp, F.lit("+00:00")), F.lit("yyyy-MM-dd HH:mm:ssXXX")))


def short_date(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "MM/dd HH:mm")


def job_path(root: Column, job_id: Column, name: str) -> Column:
    """Partition-style path of a job's file."""
    return F.concat(root, F.lit("/job_id="), safe_directory(job_id), F.lit(f"/{name}"))


def history_path(root: Column, library_id: Column) -> Column:
    return F.concat(root, F.lit("/library_id="), library_id.cast("string"))


def dictionary_path(profile: Column) -> Column:
    """Where a profile keeps its dictionary."""
    return F.concat(profile, F.lit("/dictionary.json"))
