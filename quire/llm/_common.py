"""Shared plumbing of the training-data operators: table access, scratch tables, Arrow text views."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.sources.batches import bound_batches
from quire.sources.scratch import release_tables, shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_scope: ContextVar[str] = ContextVar("scope", default="")


def materialize(df: DataFrame, name: str, compression: str = "snappy", scoped: bool = True) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends at a durable table."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{_scratch(spark)}/{_scope.get() * scoped}{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_scope(spark: SparkSession, name: str):
    """Tables that are materialized inside are deleted at the end; what shall stay is written with ``scoped=False``."""
    held = _scope.set(f"{_scope.get()}{name}-{uuid.uuid4().hex}/")
    try:
        yield
    finally:
        _delete(spark, f"{_scratch(spark)}/{_scope.get()}")
        _scope.reset(held)


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/quire-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release_scratch(spark: SparkSession) -> None:
    """Deletes this application's scratch tables; call it once the results that read them are written."""
    _delete(spark, _scratch(spark))
    release_tables(spark)


def text_array(column: pa.Array) -> pa.Array:
    """A string column with nulls as empty texts, at offset 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    return column


def text_chunks(column: pa.Array, limit: int = 1 << 20, rows: int = 4096) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Views of consecutive rows: (first row, end row, bytes, offsets from 0), about ``limit`` bytes, one row at least."""
    column = text_array(column)
    n = len(column)
    if n == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(n, lo + rows, max(hi, lo + 1))
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def append_columns(df: DataFrame, text: str, make, added: str) -> DataFrame:
    """``df`` with columns computed from its text column in one narrow Arrow stage.

    ``make()`` runs once a task and returns a function from a string array (no nulls) to the new arrays. All columns
    pass through by position, so names that clash with internal ones do no harm; one that equals an added name (in any
    case) gives way to the added column.
    """
    new = T._parse_datatype_string(added)
    names = df.columns
    at = names.index(text)
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate([*df.schema.fields, *new.fields])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                cols = [*batch.columns, *work(text_array(batch.column(at)))]
                yield pa.RecordBatch.from_arrays(cols, [f"c{i}" for i in range(len(cols))])

    made = df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, schema)
    taken = {n.lower() for n in new.names}
    return made.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate([*names, *new.names]) if i >= len(names) or n.lower() not in taken])


def held_out(doc_id, folds: int, fold: int):
    """Whether crc32 of the id's decimal text falls in the held-out fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % F.lit(folds) == F.lit(fold), F.lit(False))


def label_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, bound: int, longest: int) -> DataFrame:
    """doc_id, text and label of at most ``bound`` labelled documents outside the held-out fold, the same ones each run.

    Only the bounded list of ids is broadcast. Texts over ``longest`` characters aren't learnt from. Of several rows of
    an id the least text counts, of several labels the largest.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= longest)
    return texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_y").alias("_y"))
