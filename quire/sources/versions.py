"""Tables kept as an append log: a save adds rows, a read takes the newest of each key, compaction folds what is stale.

``<path>/data/batch=<id>`` holds the rows of one save as Parquet, ``<path>/commits/<number>`` the small JSON file that makes it
count. A commit takes the next free number by creating a file that wasn't there, which one writer alone can do, so
writers at once lose nothing; what was written without a commit is never read, so a cut-off save is invisible. A
compaction's commit names the number up to which its rows replace all others, and later ones still count.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Share of rows that newer ones have replaced from which on a compaction is due.
STALE = 0.5


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _claim(spark: SparkSession, path: str, content: bytes) -> bool:
    """Creates a file unless it is there. Hadoop's local file system looks first and creates then, so there the system call does it."""
    at, store = _store(spark, path)
    store.mkdirs(at.getParent())
    if store.getScheme() == "file":
        try:
            handle = os.open(urlparse(path).path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            return False
        with os.fdopen(handle, "wb") as f:
            f.write(content)
        return True
    if store.exists(at):
        return False
    try:
        out = store.create(at, False)
    except Exception as e:
        if "AlreadyExists" in str(e):
            return False
        raise
    out.write(content)
    out.close()
    return True


def commits(spark: SparkSession, path: str) -> list[tuple[int, dict]]:
    """Number and content of all commits in order; one that was cut off while it was written is left out."""
    at, store = _store(spark, f"{path}/commits")
    if not store.exists(at):
        return []
    numbers = sorted(int(f.getPath().getName()) for f in store.listStatus(at) if f.getPath().getName().isdigit())
    if not numbers:
        return []
    texts = {int(r.path.rsplit("/", 1)[1]): r.value for r in spark.read.text(f"{path}/commits", wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").collect()}
    out = []
    for n in numbers:
        try:
            out.append((n, json.loads(texts.get(n, ""))))
        except ValueError:
            continue
    return out


def _commit(spark: SparkSession, path: str, content: dict) -> int:
    at, store = _store(spark, f"{path}/commits")
    taken = [int(f.getPath().getName()) for f in store.listStatus(at) if f.getPath().getName().isdigit()] if store.exists(at) else []
    number = max(taken, default=0) + 1
    while not _claim(spark, f"{path}/commits/{number:020d}", json.dumps(content).encode()):
        number += 1
    return number


def append(rows: DataFrame, path: str) -> int:
    """Saves rows as the newest of their keys; a row whose ``gone`` is true deletes its key. Returns the commit's number."""
    spark, batch = rows.sparkSession, uuid.uuid4().hex
    kept = rows if "gone" in rows.columns else rows.withColumn("gone", F.lit(False))
    kept.write.parquet(f"{path}/data/batch={batch}")
    return _commit(spark, path, {"batch": batch})


def _live(spark: SparkSession, path: str) -> tuple[list[tuple[int, str]], int]:
    """(number, batch) of what a read takes, and the last number."""
    known = commits(spark, path)
    base = max(((c["upto"], n, c["batch"]) for n, c in known if "upto" in c), default=None)
    live = [(base[0], base[2])] if base else []
    return live + [(n, c["batch"]) for n, c in known if "upto" not in c and (not base or n > base[0])], max((n for n, _ in known), default=0)


def versions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows that count, with gone and version; as many folders are read as were committed since the last compaction."""
    live, _ = _live(spark, path)
    full = f"{schema}, gone boolean"
    if not live:
        return spark.createDataFrame([], f"{full}, version bigint")
    numbers = spark.createDataFrame([(b, n) for n, b in live], "batch string, version bigint")
    rows = spark.read.schema(f"{full}, batch string").option("basePath", f"{path}/data").parquet(*[f"{path}/data/batch={b}" for _, b in live])
    return rows.join(F.broadcast(numbers), "batch").drop("batch")


def latest(spark: SparkSession, path: str, schema: str, keys: list[str], version: bool = False) -> DataFrame:
    """The newest row of each key that isn't gone (of several in one save the largest as JSON)."""
    rows = versions(spark, path, schema)
    rest = [c for c in rows.columns if c not in (*keys, "version")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest, "version"), F.struct("version", F.to_json(F.struct(*rest)))).alias("r")).select(*keys, "r.*").where("not gone")
    names = [c for c in rows.columns if c not in ("gone", "version")]
    return newest.select(*names, *(["version"] if version else []))


def newest(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """All rows of the newest save of each key that aren't gone. Keys alone are grouped, and nothing is where there was one save."""
    rows = versions(spark, path, schema)
    names = [c for c in rows.columns if c not in ("gone", "version")]
    if len(_live(spark, path)[0]) > 1:
        last = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max("version").alias("_version"))
        same = F.col("version") == F.col("_version")
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
        rows = rows.join(last, same, "left_semi")
    return rows.where("not gone").select(*names)


def compact(spark: SparkSession, path: str, schema: str, keys: list[str], stale: float = STALE) -> int | None:
    """Folds the log to its newest rows if the share of others reaches ``stale``; saves committed meanwhile stay as they are."""
    live, last = _live(spark, path)
    if len(live) < 2:
        return None
    total = versions(spark, path, schema).count()
    current = latest(spark, path, schema, keys)
    left = current.count()
    if total and 1 - left / total < stale:
        return None
    batch = uuid.uuid4().hex
    # read again from the commits that were counted: later ones are newer than ``last``
    upto = versions(spark, path, schema).where(F.col("version") <= last)
    rest = [c for c in upto.columns if c not in (*keys, "version")]
    newest = upto.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("version", F.to_json(F.struct(*rest)))).alias("r")).select(*keys, "r.*").where("not gone")
    newest.write.parquet(f"{path}/data/batch={batch}")
    return _commit(spark, path, {"batch": batch, "upto": last})


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes data that no read takes any more (run it when no save or long read is under way); returns how many folders went."""
    keep = {b for _, b in _live(spark, path)[0]}
    at, store = _store(spark, f"{path}/data")
    gone = [f.getPath() for f in store.listStatus(at) if f.getPath().getName().removeprefix("batch=") not in keep] if store.exists(at) else []
    for folder in gone:
        store.delete(folder, True)
    return len(gone)
