"""Whole translation runs: batches to a model client by the JSON protocol, else the text protocol, a repair round of single blocks,
and the run over many documents with reuse of finished ones."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quire.functions import text as fx
from quire.operators import batching, protocol, render, structure, validate
from quire.operators.jobs import masked, with_retry
from quire.sources.batches import bound_batches
from quire.sources.readers import first_existing
from quire.sources.scratch import keep

JSON_TASK = 'Translate each source into {}. Keep ⟦…⟧ tokens. Answer as {{"translations": {{id: text}}}}.'
TEXT_TASK = "Translate each part into {}. Keep ⟦…⟧ tokens. Answer each part under its own @@id line."
COLUMNS = ("doc_id", "pos", "id", "type", "source", "translation", "status", "error")


def read_answers(output: str, as_json: bool) -> dict[str, str]:
    """id to text of one answer, by either protocol."""
    if as_json:
        body = re.sub(r"\s*```\Z", "", re.sub(r"(?i)\A```(?:json)?\s*", "", output.strip()))
        found = json.loads(body).get("translations")
        if not isinstance(found, dict):
            raise ValueError("the answer has no translations object")
        return {k: v.strip() for k, v in found.items() if isinstance(v, str) and v.strip()}
    parts = re.split(r"(?m)^[ \t]*@@([A-Za-z0-9_-]+)[ \t]*$", re.sub(r"\r\n?", "\n", output))[1:]
    return {k: v.strip() for k, v in zip(parts[::2], parts[1::2]) if v.strip()}


def request(blocks: list[dict], client: Callable[[list[dict], bool], str], language: str) -> tuple[dict[str, str], int, str | None]:
    """id to text, how many requests and the error of one batch (blocks with id, type, protected): one that fails by JSON is asked for
    again as text, and one that fails so too is an error (secrets masked)."""
    asked = 0

    def once(as_json: bool) -> dict[str, str]:
        nonlocal asked
        asked += 1
        payload = json.dumps([{"id": b["id"], "type": b["type"], "source": b["protected"]} for b in blocks], ensure_ascii=False) if as_json else "\n\n".join(f"@@{b['id']}\n{b['protected']}" for b in blocks)
        task = (JSON_TASK if as_json else TEXT_TASK).format(language)
        return read_answers(client([{"role": "system", "content": task}, {"role": "user", "content": payload}], as_json), as_json)

    got, error = {}, None
    try:
        got = with_retry(lambda: once(True))
    except Exception:  # noqa: BLE001
        try:
            got = with_retry(lambda: once(False))
        except Exception as e:  # noqa: BLE001
            error = masked(f"request failed: {e}")
    return got, asked, error


def ask(batches: DataFrame, client: Callable[[list[dict], bool], str], language: str, parallel: int = 2) -> DataFrame:
    """doc_id, id, translation, requests, error of (doc_id, batch_no, blocks array<struct<id,type,protected>>), batches planned before: those of a document
    are asked for in at most ``parallel`` rows at once, documents in as many tasks as there are (see :func:`request`)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            out = []
            for r in rows.itertuples():
                blocks = [dict(b) if isinstance(b, dict) else b.asDict() for b in r.blocks]
                got, asked, error = request(blocks, client, language)
                out += [(r.doc_id, b["id"], got.get(b["id"]), asked, error) for b in blocks]
            yield pd.DataFrame(out, columns=["doc_id", "id", "translation", "requests", "error"])

    tasks = max(parallel, int(batches.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return batches.repartition(tasks, "doc_id", F.col("batch_no") % parallel).mapInPandas(run, "doc_id bigint, id string, translation string, requests bigint, error string")


def _ask_rows(rows: DataFrame, client, language: str, max_chars: int, max_blocks: int, parallel: int) -> DataFrame:
    """Rows (doc_id, id, type, source, protected, size, asked, ...) in order of document and place with their answer and refused, where ``asked``.

    Rows are packed into batches as they come, so no document is gathered, and pass through with all their columns, so no answer looks
    for its text. Requests of a task run in at most ``parallel`` threads; a task has whole documents.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answered(table: pa.Table, starts: list[int]) -> Iterator[pa.RecordBatch]:
            ids, types, wanted = (table[c].to_pylist() for c in ("id", "type", "asked"))
            texts = [p if p is not None else s or "" for p, s in zip(table["protected"].to_pylist(), table["source"].to_pylist())]
            batches = [range(a, b) for a, b in zip(starts, [*starts[1:], len(ids)]) if wanted[a]]
            answers, errors = [None] * len(ids), [None] * len(ids)

            def lane(own: list[range]) -> None:
                for batch in own:
                    got, _, error = request([{"id": ids[i], "type": types[i], "protected": texts[i]} for i in batch], client, language)
                    for i in batch:
                        answers[i], errors[i] = got.get(ids[i]), error

            list(pool.map(lane, [batches[k::parallel] for k in range(min(parallel, len(batches)))]))
            return table.append_column("answer", pa.array(answers, pa.string())).append_column("refused", pa.array(errors, pa.string())).to_batches()

        with ThreadPoolExecutor(parallel) as pool:
            rest = None
            for part in parts:
                table = pa.Table.from_batches([part]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([part])])
                starts = batching.row_starts(*(table[c].to_pylist() for c in ("doc_id", "id", "size")), max_chars, max_blocks)
                if starts:  # the last batch may go on in the next rows
                    yield from answered(table.slice(0, starts[-1]), starts[:-1])
                    rest = table.slice(starts[-1])
            if rest is not None:
                yield from answered(rest, [0])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("answer", StringType()), StructField("refused", StringType())]))


def translate_blocks(blocks: DataFrame, client, language: str = "zh-CN", max_chars: int = batching.MAX_CHARS, max_blocks: int = batching.MAX_BLOCKS, parallel: int = 2, store=None) -> DataFrame:
    """Blocks with the pending ones translated: a round of batches, then a round of single blocks for what failed.

    Texts move once, to tasks of whole documents, where both rounds and their judgement follow each other without a table between
    them. ``store`` (DataFrame -> DataFrame) keeps the rows, so that a client is asked once by all that reads them; by default a table in the
    shared folder (a lost task asks again for its documents). The client is called from ``parallel`` threads of a task. What is left after both rounds stays failed (see :func:`leftover`).
    """
    spark = blocks.sparkSession
    bound_batches(spark)
    pending = fx.is_pending(F.col("type"), F.col("translation"), F.col("status"))
    safe = protocol.protect_texts(blocks.where(pending).select("doc_id", "pos", "id", "type", "source"))
    once = safe.withColumn("protected", F.when(F.size("spans") > 0, F.col("protected")))  # else it is the source, which needn't move twice
    tasks = max(parallel, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = once.repartition(tasks, "doc_id").sortWithinPartitions("doc_id", "pos", "id").withColumns({"size": F.coalesce(fx.js_length(F.col("source")), F.lit(0)), "asked": F.lit(True)})
    first = protocol.judge(_ask_rows(rows, client, language, max_chars, max_blocks, parallel), F.lit(language))
    outcome = ("translation", "status", "error")
    again = first.withColumn("asked", F.col("status") == "failed").withColumnsRenamed({c: f"_{c}" for c in outcome})
    second = protocol.judge(_ask_rows(again, client, language, 1, 1, min(2, parallel)), F.lit(language))
    store = store or (lambda df: keep(df, "translated", "zstd"))
    done = store(second.select(*[F.when(F.col("asked"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) if c in outcome else c for c in COLUMNS]))
    kept = blocks.where(~F.coalesce(pending, F.lit(False)))
    return kept.select(*[F.col(c) if c in blocks.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS]).unionByName(done)


def leftover(blocks: DataFrame) -> DataFrame:
    """doc_id, error: documents whose blocks are still without a translation, with how many and the first ids."""
    report = validate.missing_report(blocks)
    return report.select("doc_id", F.concat(F.col("n_missing").cast("string"), F.lit(" blocks without a translation: "), F.array_join("first_ids", ", ")).alias("error"))


def unfinished(sources: DataFrame, finished: DataFrame) -> DataFrame:
    """Sources whose (doc_id, fingerprint) has no finished row: what a rerun has left to do."""
    return sources.join(finished.select("doc_id", "fingerprint"), ["doc_id", "fingerprint"], "left_anti")


def run_documents(parsed: DataFrame, client, language: str = "zh-CN", store=None, **limits) -> tuple[DataFrame, DataFrame]:
    """Blocks and outcome (doc_id, valid, n_issues, error, body) of parsed documents: structure, translate, sanitize, validate, render.
    Only valid documents have a body."""
    store = store or keep
    blocks = store(structure.structure_documents(parsed))
    todo = blocks.withColumn("translation", F.lit(None).cast("string"))
    done = protocol.repair_translations(translate_blocks(todo, client, language, store=store, **limits)).drop("changed")
    full = store(done.join(blocks.select("doc_id", "id", "asset_path", "source_asset_path"), ["doc_id", "id"]))
    issues = validate.issues(full, F.lit(language))
    outcome = validate.rollup(parsed.select("doc_id"), issues).join(leftover(full).withColumnRenamed("error", "_left"), "doc_id", "left")
    outcome = outcome.withColumn("error", F.coalesce("_left", "error")).drop("_left")
    bodies = render.render_bodies(full)
    return full, outcome.join(bodies, "doc_id", "left").withColumn("body", F.when(F.col("valid"), F.col("body")))


def resume_documents(parsed: DataFrame, client, root: str, language: str = "zh-CN", **limits) -> DataFrame:
    """Outcomes (with fingerprint) of all runs kept under ``root``, after those of ``parsed`` (doc_id, fingerprint, markdown,
    assets) without a valid one of the same fingerprint were run and added; a changed source is thus run again."""
    spark, kept = parsed.sparkSession, f"{root}/outcomes"
    schema = "doc_id bigint, valid boolean, n_issues bigint, error string, body string, fingerprint string"
    before = spark.read.schema(schema).parquet(kept) if first_existing(spark, [kept]) else spark.createDataFrame([], schema)
    todo = unfinished(parsed, before.where("valid"))
    outcome = run_documents(todo, client, language, **limits)[1].join(todo.select("doc_id", "fingerprint"), "doc_id")
    outcome.select(*[c.split()[0] for c in schema.split(", ")]).write.mode("append").parquet(kept)
    return spark.read.schema(schema).parquet(kept)


def repair_run(blocks: DataFrame, client, language: str = "zh-CN", **limits) -> DataFrame:
    """Boundaries merged with their translations reset, defective connectors cleared, the rest sanitized, and only what is
    then without a translation asked for again."""
    fixed = structure.repair_documents(blocks, reset=True)
    cleared = protocol.clear_connectors(fixed, F.lit(language)).drop("cleared")
    clean = protocol.repair_translations(cleared).drop("changed")
    renumbered = clean.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1)
    return translate_blocks((limits.get("store") or keep)(renumbered), client, language, **limits)
