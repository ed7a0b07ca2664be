"""Scans: glossaries, histories, dictionaries, jobs, text layers, archives and model completions as DataFrames."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as fx
from quire.operators.jobs import Truncated, with_retry
from quire.operators.lexicon import from_csv, from_tsv, ingest_dictionary
from quire.sources import versions
from quire.sources.writers import bucket_of, restore

GLOSSARY = "library_id bigint, entries array<struct<term:string,translation:string,field:string,note:string>>"
RECORD = "id:string,selected:string,context:string,level:int,result:string,item_id:string,page:int,ts_ms:bigint,operation:string,dictionary:struct<phonetic:string,translation:string,pos:string>,dictionary_only:boolean"
HISTORY = f"library_id bigint, records array<struct<{RECORD}>>"
JOB = (
    "id string, attachment_id bigint, fingerprint string, stage string, last_active_stage string, completed bigint, total bigint, "
    "usage struct<prompt:bigint,completion:bigint,total:bigint,requests:bigint>, updated_ms bigint"
)
NO_TEXT, NO_MARKDOWN = "the document has no text", "the archive has no markdown"
ITEMS = "doc_id bigint, page int, ord int, str string, x double, y double, width double, height double"


def _json(spark: SparkSession, path: str, schema: str, mode: str = "DROPMALFORMED", lines: bool = False) -> DataFrame:
    """A JSON scan of whole files (or ``lines`` of them); a missing path is an empty relation, broken rows are skipped, a
    cut-off replacement is undone."""
    restore(spark, path)
    try:
        return spark.read.schema(schema).option("mode", mode).option("ignoreMissingFiles", True).json(path, multiLine=not lines)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_glossary(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """library_id, ord, term, translation, field, note."""
    return _json(spark, path, GLOSSARY, lines=lines).select("library_id", F.posexplode("entries").alias("ord", "e")).select("library_id", F.col("ord").cast("bigint").alias("ord"), "e.*")


def read_history(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return _json(spark, path, HISTORY, lines=lines).select("library_id", F.posexplode("records").alias("ord", "r")).select("library_id", F.col("ord").cast("bigint").alias("ord"), "r.*")


def read_jobs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """All job files under a folder, broken ones skipped, the latest first."""
    return _json(spark, path, JOB, lines=lines).where("id is not null").orderBy(F.col("updated_ms").desc(), "id")


BLOCKS = "pos int, id string, type string, source string, translation string, status string, error string"


def read_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The blocks all jobs have saved (:func:`quire.sources.writers.save_documents`, or a JSON table with a folder a job), with their job_id."""
    return _json(spark, path, f"{BLOCKS}, job_id string", lines=lines).drop("bucket")


def read_document(spark: SparkSession, path: str, job_id: str, lines: bool = False) -> DataFrame:
    """The blocks of one job, of whose folder alone files are read; none if there are none."""
    restore(spark, path)
    own = f"{path}/job_id={job_id}"
    if first_existing(spark, [own]):
        return _json(spark, own, BLOCKS, lines=lines)
    bucket = spark.range(1).select(bucket_of(F.lit(str(job_id)))).first()[0]
    blocks = _json(spark, f"{path}/bucket={bucket}", f"{BLOCKS}, job_id string", lines=lines)
    return blocks.where(F.col("job_id") == str(job_id)).drop("job_id")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, value: the text of each document as its file would hold it, with a last line break (:func:`quire.sources.writers.save_markdown`)."""
    return versions.newest(spark, path, "doc_id string, value string", ["doc_id"])


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """name, value: the texts that :func:`quire.sources.writers.save_html` wrote, with their last line break."""
    file = F.url_decode(F.replace(F.element_at(F.split("_metadata.file_path", "/"), -1), F.lit("+"), F.lit("%2B")))
    spelt = F.transform(F.split(file, "%"), lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.char(F.conv(F.substring(p, 1, 2), 16, 10).cast("bigint")), F.substring(p, 3, 1 << 30))))
    return spark.read.text(path, wholetext=True).select(F.when(file != "%", F.array_join(spelt, "")).alias("name"), "value")


def read_job(spark: SparkSession, path: str, job_id: str) -> DataFrame:
    return _json(spark, path, JOB).where(F.col("id") == job_id)


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first path that Spark's file systems can see (mirrors, user files before bundled ones)."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(hadoop).exists(at):
            return p
    return None


def read_dictionary(spark: SparkSession, paths: list[str], as_object: bool = False) -> DataFrame:
    """word, phonetic, translation, pos of the first existing dictionary (user files before bundled ones); none is an empty dictionary.

    A dictionary is JSON lines, or one object {word: {p, t, s}} with ``as_object``.
    """
    schema = "word string, phonetic string, translation string, pos string"
    at = first_existing(spark, paths)
    if not at:
        return spark.createDataFrame([], schema)
    if not as_object:
        return spark.read.schema(schema).json(at)
    whole = spark.read.text(at, wholetext=True).select(F.explode(F.from_json("value", "map<string,struct<p:string,t:string,s:string>>")).alias("word", "e"))
    return whole.select("word", F.col("e.p").alias("phonetic"), F.col("e.t").alias("translation"), F.col("e.s").alias("pos"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no (from 0, in file order), value."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), "\n")).alias("line_no", "value")).withColumn("line_no", F.col("line_no").cast("bigint"))


def read_dictionary_csv(spark: SparkSession, path: str, kind: str = "full") -> DataFrame:
    return ingest_dictionary(read_lines(spark, path), kind)


def read_glossary_tsv(spark: SparkSession, path: str) -> DataFrame:
    return from_tsv(read_lines(spark, path))


def read_glossary_csv(spark: SparkSession, path: str, library_id: int, strict: bool = False) -> DataFrame:
    return from_csv(spark.read.text(path, wholetext=True).select(F.lit(library_id).cast("bigint").alias("library_id"), F.col("value").alias("csv")), strict)


def text_items(rows: DataFrame) -> DataFrame:
    """Runs with non-blank text; missing coordinates and sizes are 0."""
    zero = [F.coalesce(F.col(c), F.lit(0.0)).cast("double").alias(c) for c in ("x", "y", "width", "height")]
    return rows.where(fx.js_trim(F.coalesce("str", F.lit(""))) != "").select("doc_id", "page", "ord", "str", *zero)


def selected_text(ranges):
    """Selected ranges (array<string>) joined by a space; object stand-ins are no text; nothing is null."""
    good = F.filter(ranges, lambda r: r.isNotNull() & ~r.contains("[object"))
    return fx.blank_to_null(F.array_join(good, " "))


def parse_fulltext(rows: DataFrame, strict: bool = True) -> DataFrame:
    """(doc_id, text, title) to (doc_id, markdown, assets); a blank text is an error, or with ``strict=False`` a row whose error says so."""
    blank = fx.js_trim(F.coalesce("text", F.lit(""))) == ""
    shown = fx.with_title(F.col("text"), F.col("title"))
    assets = F.array().cast("array<struct<original_path:string,relative_path:string>>").alias("assets")
    if strict:
        return rows.select("doc_id", F.when(blank, F.raise_error(F.lit(NO_TEXT))).otherwise(shown).alias("markdown"), assets)
    return rows.select("doc_id", F.when(~blank, shown).alias("markdown"), assets, F.when(blank, NO_TEXT).alias("error"))


def unpack_archives(archives: DataFrame) -> DataFrame:
    """(doc_id, content) ZIP bytes to doc_id, markdown, assets and error: the longest .md wins (the first of equals), images are
    renamed NNNN-name in member order with their media type; an archive without markdown, or a broken one, says so in error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        kind = pa.list_(pa.struct([("original_path", pa.string()), ("relative_path", pa.string()), ("content_type", pa.string())]))
        for batch in batches:
            marks, assets, errors = [], [], []
            for v in batch.column(1):
                mark, found, error = None, [], None
                try:
                    with zipfile.ZipFile(io.BytesIO(v.as_py() or b"")) as z:
                        names = [n for n in z.namelist() if not n.endswith("/")]
                        texts = [z.read(n).decode("utf-8", "replace") for n in names if n.lower().endswith(".md")]
                        mark, error = (max(texts, key=len), None) if texts else (None, NO_MARKDOWN)
                        images = [n for n in names if n.rsplit(".", 1)[-1].lower() in fx.MEDIA and "." in n] if texts else []
                        found = [{"original_path": n, "relative_path": f"assets/{i:04d}-{re.sub('[^A-Za-z0-9._-]', '_', n.rsplit('/', 1)[-1])}", "content_type": fx.MEDIA[n.rsplit(".", 1)[-1].lower()]} for i, n in enumerate(images, 1)]
                except (zipfile.BadZipFile, OSError, RuntimeError) as e:
                    error = str(e)
                marks.append(mark)
                assets.append(found)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.string()), pa.array(assets, kind), pa.array(errors, pa.string())], ["doc_id", "markdown", "assets", "error"])

    return archives.select("doc_id", "content").mapInArrow(run, "doc_id bigint, markdown string, assets array<struct<original_path:string,relative_path:string,content_type:string>>, error string")


def complete(prompts: DataFrame, client: Callable[[list[dict]], dict], sleep: Callable[[float], None] | None = None) -> DataFrame:
    """request_id, content, prompt, completion, total, error from (request_id, messages) by an injected client.

    A request is tried again after errors that may pass and after truncated answers; what then fails, or answers nothing,
    is a row with its error.
    """
    import time

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():

                def once(r=r) -> dict:
                    got = client([dict(m.asDict() if hasattr(m, "asDict") else m) for m in r.messages])
                    if got.get("finish") == "length":
                        raise Truncated("the answer was cut off")
                    return got

                try:
                    got, error = with_retry(once, sleep or time.sleep), None
                    error = None if (got.get("content") or "").strip() else "empty answer"
                except Exception as e:  # noqa: BLE001  a failed request is a row
                    got, error = {}, str(e)
                used = got.get("usage") or {}
                out.append((r.request_id, got.get("content"), *(int(used.get(k) or 0) for k in ("prompt", "completion", "total")), error))
            yield pd.DataFrame(out, columns=["request_id", "content", "prompt", "completion", "total", "error"])

    return prompts.select("request_id", "messages").mapInPandas(run, "request_id string, content string, prompt bigint, completion bigint, total bigint, error string")


def stream_chunks(prompts: DataFrame, client: Callable[[list[dict]], Iterator[str]]) -> DataFrame:
    """request_id, seq, chunk of streamed answers by an injected client, in the order they come; :func:`quire.streaming.sse.reassemble`
    makes texts of them. A stream that breaks off ends without its end mark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples():
                chunks: list[str] = []
                try:
                    for chunk in client([dict(m.asDict() if hasattr(m, "asDict") else m) for m in r.messages]):
                        chunks.append(chunk)
                except Exception:  # noqa: BLE001, S110  what came is kept
                    pass
                yield pd.DataFrame({"request_id": [r.request_id] * len(chunks), "seq": range(len(chunks)), "chunk": chunks}).astype({"request_id": "object", "seq": "int64", "chunk": "object"})

    return prompts.select("request_id", "messages").mapInPandas(run, "request_id string, seq bigint, chunk string")


def string_pref(c, default: str):
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def number_pref(c, default: float):
    n = c.try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n) & (n > 0) & (n < float("inf")), n).otherwise(F.lit(float(default)))


def boolean_pref(c, default: bool):
    return F.coalesce(c.try_cast("boolean"), F.lit(default))
