"""Sinks: whole tables replaced by a rename, one file a key where a reader expects it."""

from __future__ import annotations

import re
import threading
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources import versions

#: Folders that the blocks of jobs are dealt to, so that there are as many files as tasks and folders, however many jobs.
BUCKETS = 64
#: Writes of one path wait for each other.
_QUEUES: dict[str, threading.Lock] = defaultdict(threading.Lock)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put_json(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Replaces a JSON table: written beside, the old one is moved aside, the new one takes its place by a rename.

    At every moment the path or ``<path>.old`` holds a whole table; :func:`restore` brings an old one back after a crash.
    """
    spark = df.sparkSession
    with _QUEUES[path]:
        restore(spark, path)
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).json(f"{path}.new")
        (here, store), (new, _), (old, _) = (_files(spark, path + end) for end in ("", ".new", ".old"))
        store.delete(old, True)
        if store.exists(here):
            store.rename(here, old)
        if not store.rename(new, here):
            raise OSError(f"{path} can't be replaced")
        store.delete(old, True)


def bucket_of(job_id):
    """The folder of a job's blocks."""
    return F.pmod(F.xxhash64(job_id.cast("string")), F.lit(BUCKETS)).cast("int")


def save_documents(blocks: DataFrame, path: str) -> None:
    """(job_id, ...): the blocks of all jobs as one JSON table, replaced whole; a job's blocks are in one of ``BUCKETS`` folders."""
    put_json(blocks.withColumn("bucket", bucket_of(F.col("job_id"))), path, ("bucket",))


def restore(spark: SparkSession, path: str) -> None:
    """Undoes a replacement that was cut off between its two renames."""
    (here, store), (old, _) = (_files(spark, path + end) for end in ("", ".old"))
    if not store.exists(here) and store.exists(old):
        store.rename(old, here)


def save_stamped(df: DataFrame, path: str, now_ms: int | None = None) -> None:
    stamp = F.lit(now_ms).cast("bigint") if now_ms is not None else F.unix_millis(F.current_timestamp())
    put_json(df.withColumn("updated_ms", stamp), path)


def save_dictionary(dictionary: DataFrame, path: str) -> DataFrame:
    """Writes one row a word and reads the table back."""
    put_json(dictionary, path)
    return dictionary.sparkSession.read.schema(dictionary.schema).json(path)


def save_glossary(entries: DataFrame, path: str) -> None:
    """(library_id, ord, term, translation, field, note): one JSON object a library, entries in order."""
    lists = F.transform(F.array_sort(F.collect_list(F.struct("ord", "term", "translation", "field", "note"))), lambda e: e.dropFields("ord"))
    put_json(entries.groupBy("library_id").agg(lists.alias("entries")), path)


def save_history(records: DataFrame, path: str) -> None:
    """(library_id, ord, ...): one JSON object a library, the newest record first."""
    rest = [c for c in records.columns if c not in ("library_id", "ord")]
    lists = F.transform(F.sort_array(F.collect_list(F.struct("ord", *rest)), asc=False), lambda r: r.dropFields("ord"))
    put_json(records.groupBy("library_id").agg(lists.alias("records")), path)


def html_file(name: str | None) -> str:
    """The file of a name: what a file name can't hold, and a beginning that hides a file, as its code; no name is a lone %."""
    spelt = re.sub(r'[\x00-\x1f%/\\\\:*?"<>|#]|^[._]', lambda m: f"%{ord(m[0]):02X}", name or "")
    return spelt or "%"


def save_html(bodies: DataFrame, path: str) -> None:
    """(name, html): a text file for each name in one folder, older ones of the same names replaced (see
    :func:`quire.sources.readers.read_html`). Tasks write the files beside and rename them, so no commit walks through all names;
    the folder is one that every executor can reach (any pyarrow file system)."""
    root = path if "://" in path else f"file://{path}"

    def write(rows) -> None:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(root)
        store.create_dir(at, recursive=True)
        for r in rows:
            beside = f"{at}/.{uuid.uuid4().hex}"
            with store.open_output_stream(beside) as f:
                f.write(((r.html or "") + "\n").encode())
            store.move(beside, f"{at}/{html_file(r.name)}")

    bodies.select("name", "html").foreachPartition(write)


def save_markdown(parsed: DataFrame, path: str) -> None:
    """(doc_id, markdown): the raw text of each document beside its blocks, a row of an append log for each; texts saved before of the
    same documents are replaced, others stay (see :func:`quire.sources.readers.read_markdown`)."""
    versions.append(parsed.select(F.col("doc_id").cast("string").alias("doc_id"), F.concat("markdown", F.lit("\n")).alias("value")), path)


def save_assets(assets: DataFrame, root: str) -> None:
    """(relative_path, content) written as files under a root that every executor can reach (any pyarrow file system)."""

    def write(rows) -> None:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(root)
        for r in rows:
            name = f"{at}/{r.relative_path}"
            store.create_dir(name.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(name) as f:
                f.write(bytes(r.content))

    assets.select("relative_path", "content").foreachPartition(write)


def save_preferences(values: dict) -> dict:
    """Options with their limits: concurrency 1 to 4, batch characters from 4000, output tokens from 2048."""
    out = dict(values)
    for name, least, most in (("concurrency", 1, 4), ("batch_chars", 4000, None), ("output_tokens", 2048, None)):
        if name in out:
            out[name] = max(least, int(out[name])) if most is None else min(most, max(least, int(out[name])))
    return out
