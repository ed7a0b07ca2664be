"""How much of a table goes to Python at a time."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch at most (one row at least): whole texts go to Python in these, however long they are.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of an Arrow batch; a count of rows alone would let long texts fill gigabytes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key).removesuffix("b")
    if not own.isdigit() or int(own) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")
