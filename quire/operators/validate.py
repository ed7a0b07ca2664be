"""Document validation: one row for each issue, in block order, and the rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as fx
from quire.operators.structure import anomalies

# Fixed value: messages in an error text.
SHOWN = 12


def issues(blocks: DataFrame, language: Column | None = None, boundaries: bool = True) -> DataFrame:
    """doc_id, ord, block_id, code, message from (doc_id, pos, id, type, source, translation, asset_path); boundary issues come last."""
    language = F.lit("zh-CN") if language is None else language
    t, kind = F.col("translation"), F.col("type")
    has = F.coalesce(t != "", F.lit(False))
    again = F.row_number().over(Window.partitionBy("doc_id", "id").orderBy("pos")) > 1
    rules = (
        ("duplicate-id", F.col("_again"), ("Duplicate block id: ", "")),
        ("missing-source", ~kind.isin("image", "drop") & (fx.js_trim(F.coalesce("source", F.lit(""))) == ""), ("Block ", " has no source text")),
        ("missing-translation", fx.is_translatable(kind) & (fx.js_trim(F.coalesce(t, F.lit(""))) == ""), ("Block ", " has no translation")),
        ("unresolved-placeholder", has & fx.has_placeholder(t), ("Block ", " contains an unresolved protected token")),
        ("protocol-leak", has & fx.leaks_protocol(t), ("Block ", " contains a leaked translation protocol marker")),
        ("untranslated-connector", has & fx.has_untranslated_connector(t, language), ("Block ", " contains an untranslated narrative connector")),
        ("missing-asset", (kind == "image") & (F.coalesce("asset_path", F.lit("")) == ""), ("Image block ", " has no local asset")),
    )
    found = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(i).alias("rule"), F.lit(code).alias("code"), F.concat(F.lit(a), F.col("id"), F.lit(b)).alias("message"))) for i, (code, cond, (a, b)) in enumerate(rules)]))
    own = blocks.withColumn("_again", again).select("doc_id", "pos", F.col("id").alias("block_id"), F.explode(found).alias("f")).select("doc_id", F.lit(0).alias("part"), "pos", F.col("f.rule").alias("rule"), "block_id", "f.code", "f.message")
    if boundaries:
        late = anomalies(blocks).select("doc_id", F.lit(1).alias("part"), "pos", F.lit(0).alias("rule"), "block_id", "code", "message")
        own = own.unionByName(late)
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "pos", "rule"))
    return own.withColumn("ord", order).select("doc_id", "ord", "block_id", "code", "message")


def rollup(documents: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, valid, n_issues, error (the first messages) for every row of ``documents`` (doc_id)."""
    lists = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_issues"), F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ord", "message"))), lambda x: x["message"]), 1, SHOWN), "; ").alias("error"))
    return documents.join(lists, "doc_id", "left").select("doc_id", F.col("n_issues").isNull().alias("valid"), F.coalesce("n_issues", F.lit(0)).cast("bigint").alias("n_issues"), "error")


def missing_report(blocks: DataFrame) -> DataFrame:
    """doc_id, n_missing, first_ids: translatable blocks without a translation."""
    open_ = blocks.where(fx.is_translatable(F.col("type")) & (F.coalesce("translation", F.lit("")) == ""))
    ids = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]), 1, SHOWN)
    return open_.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_missing"), ids.alias("first_ids"))
