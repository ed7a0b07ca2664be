"""Running counts and sums in an order, by ranges, so that one key with any number of rows is spread over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.sources.scratch import keep


def running(rows: DataFrame, key: str, order: list[str], sums: list[str], store=keep) -> DataFrame:
    """``rows`` with nth, their place in their key, and ``sums`` as running totals (64 bits; key isn't null), by ranges of (key, order).

    The column part numbers the ranges in order. What the ranges hand on is one row each, which alone is broadcast. ``store``
    (DataFrame -> DataFrame) keeps the ranges' own sums.
    """
    values = ["nth", *sums]
    names = [c for c in rows.columns if c not in sums] + sums
    schema = T.StructType([rows.schema[c] for c in names] + [T.StructField("nth", T.LongType()), T.StructField("part", T.IntegerType())])
    key_at, sums_at = names.index(key), len(names) - len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, held = TaskContext.get().partitionId(), None, np.zeros(1 + len(sums), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(key_at).to_numpy(zero_copy_only=False)
            total = np.stack([np.ones(n, np.int64), *(batch.column(sums_at + i).to_numpy(zero_copy_only=False) for i in range(len(sums)))]).cumsum(axis=1)
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            before = np.concatenate([np.zeros((len(total), 1), np.int64), total[:, first[1:] - 1]], axis=1)
            if last == keys[0]:
                before[:, 0] -= held
            total -= np.repeat(before, np.diff([*first, n]), axis=1)
            last, held = keys[-1], total[:, -1].copy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:sums_at], *(pa.array(v) for v in total[1:]), pa.array(total[0]), pa.array(np.full(n, part, np.int32))], schema.names)

    dealt = rows.select(*names).repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    local = store(dealt.mapInArrow(run, schema))
    ends = local.groupBy("part").agg(F.min(key).alias("first"), F.max(F.struct(F.col(key).alias("last"), *values)).alias("e")).select("part", "first", "e.*")
    through = Window.partitionBy("last").orderBy("part")
    handed = ends.select("part", "first", F.struct("last", *[F.sum(v).over(through).alias(v) for v in values]).alias("e"))
    handed = handed.withColumn("e", F.lag("e").over(Window.orderBy("part"))).where(F.col("e.last") == F.col("first"))
    carry = handed.select("part", F.col("first").alias(key), *[F.col(f"e.{v}").alias(f"_{v}") for v in values])
    met = local.join(F.broadcast(carry), ["part", key], "left")
    return met.select("part", *names[:sums_at], *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values])
