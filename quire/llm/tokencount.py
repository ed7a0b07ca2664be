"""Token counts of flat, unindexed token files by a separator scan.

A token file is nothing but ids of a fixed width, documents ended by an end-of-document id. Files are cut into blocks
without regard to documents; each block is searched for separators in one vectorised pass, and what a block can't
know, where its first document began and how many came before, is stitched by a two-level prefix scan (inside runs of blocks,
then over the runs), so even one huge file is scanned by many tasks.

Defined results: empty documents count 0 tokens; tokens after a file's last separator are a document marked incomplete;
a file of an odd number of bytes is read to its last whole token; null and empty texts are written as a lone separator;
very long texts run over as many blocks as they need; repeated rows are documents of their own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm._common import materialize, table, text_array
from quire.llm.bpe import TOKENIZER, Encoder, vocabulary

#: Bytes of a block (a multiple of the token width); blocks of a run of the prefix scan.
BLOCK, RUN = 1 << 20, 1024


def scan_blocks(blocks: DataFrame, eod: int, width: int = 2) -> DataFrame:
    """file, ordinal, start, n_tokens, complete of every document in ``blocks`` (file, block, data)."""
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for v in batch.column(2):
                data = v.as_buffer()
                ids = np.frombuffer(data, kind, len(data) // width)
                at = np.flatnonzero(ids == eod).astype(np.int64)
                out.append((len(ids), len(at), len(ids) - int(at[-1]) - 1 if len(at) else len(ids), at))
            n, ends, tail, marks = zip(*out) if out else ([], [], [], [])
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip((n, ends, tail, marks), kinds))], ["file", "block", "n", "ends", "tail", "marks"])

    file_type = blocks.schema["file"].dataType.simpleString()
    found = blocks.select("file", F.col("block").cast("bigint").alias("block"), "data").mapInArrow(run, f"file {file_type}, block bigint, n bigint, ends bigint, tail bigint, marks array<bigint>")
    found = materialize(found.withColumn("run", F.floor(F.col("block") / RUN)), "tokencount-blocks")
    # inside a run: tokens and separators before the block, and the place after the last separator so far
    inside = Window.partitionBy("file", "run").orderBy("block")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("ends") > 0, F.sum("n").over(inside) - F.col("tail"))
    local = (
        found.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("seen", F.coalesce(F.sum("ends").over(before), F.lit(0)))
        .withColumn("mark", mark).withColumn("last", F.max("mark").over(before))
    )
    runs = local.groupBy("file", "run").agg(F.sum("n").alias("rn"), F.sum("ends").alias("re"), F.max("mark").alias("rm"), F.max("block").alias("rb"))
    over = Window.partitionBy("file").orderBy("run")
    up_to = over.rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        runs.withColumn("r_at", F.coalesce(F.sum("rn").over(up_to), F.lit(0))).withColumn("r_seen", F.coalesce(F.sum("re").over(up_to), F.lit(0)))
        .withColumn("r_last", F.coalesce(F.max(F.col("r_at") + F.col("rm")).over(up_to), F.lit(0))).withColumn("final", F.max("rb").over(Window.partitionBy("file")))
        .select("file", "run", "r_at", "r_seen", "r_last", "final")
    )
    stitched = local.join(runs, ["file", "run"]).select(
        "file", "ends", "tail", "n", "marks", (F.col("r_seen") + F.col("seen")).alias("base"), (F.col("r_at") + F.col("at")).alias("at"),
        F.coalesce(F.col("r_at") + F.col("last"), F.col("r_last")).alias("open"), (F.col("block") == F.col("final")).alias("final"),
    )
    rest = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("at") + F.col("n") - F.col("open"))
    stops = F.when(F.col("final") & (rest > 0), F.concat("marks", F.array("n"))).otherwise(F.col("marks"))  # where documents end
    rows = stitched.withColumn("stops", stops).select("base", "at", "open", "ends", "stops", "file", F.posexplode("stops").alias("pos", "stop"))
    start = F.when(F.col("pos") == 0, F.col("open")).otherwise(F.col("at") + F.get("stops", F.col("pos") - 1) + 1)
    return rows.select("file", (F.col("base") + F.col("pos")).alias("ordinal"), start.alias("start"), (F.col("at") + F.col("stop") - start).alias("n_tokens"), (F.col("pos") < F.col("ends")).alias("complete"))


#: Stores whose files are read by byte ranges (pyarrow's file systems).
RANGED = ("", "file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")


def read_token_files(spark: SparkSession, path: str, block: int = BLOCK, ranged: bool | None = None) -> DataFrame:
    """(file, block, data) of raw token files. ``ranged`` reads byte ranges by pyarrow's file systems, for files of any size (the
    default for the stores it knows); otherwise Spark's own reader takes each file whole (any store, under 2 GB a file)."""
    ranged = path.partition(":")[0].lower() in RANGED or "://" not in path if ranged is None else ranged
    files = spark.read.format("binaryFile").load(path)
    blocks = F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("length") / block) - 1, F.lit(0)))).alias("i", "block")
    if not ranged:
        return files.select("path", "content", blocks).select(F.col("path").alias("file"), "block", F.expr(f"substring(content, cast(block * {block} + 1 as int), {block})").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, at = fs.FileSystem.from_uri(name)
                with store.open_input_file(at) as f:
                    f.seek(number * block)
                    yield pa.RecordBatch.from_pydict({"file": [name], "block": [number], "data": [f.read(block)]})

    listed = files.select("path", "length").select("path", blocks).select("path", "block")
    return listed.repartition("path", "block").mapInArrow(run, "file string, block bigint, data binary")


def token_blocks(docs: DataFrame, path: str, block: int = BLOCK) -> DataFrame:
    """Documents written end to end as flat token files, one for each task: file, block, data, and the manifest (first, doc_ids)
    of the documents that end in the block. Special tokens' strings in a text are ordinary text here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file = TaskContext.get().partitionId()
        vocab = vocabulary(path)
        encoder, eod = Encoder(vocab, special=False), next(iter(vocab.special.values()))
        held, pending, number, first = bytearray(), [], 0, 0  # pending: (end within held, doc_id)

        def emit(size: int) -> pa.RecordBatch:
            nonlocal number, first
            own = [d for end, d in pending if end <= size]
            out = pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([number], pa.int64()), pa.array([bytes(held[:size])], pa.binary()), pa.array([first], pa.int64()), pa.array([own], pa.list_(pa.int64()))], ["file", "block", "data", "first", "doc_ids"])
            pending[:] = [(end - size, d) for end, d in pending[len(own) :]]
            del held[:size]
            number, first = number + 1, first + len(own)
            return out

        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = text_array(batch.column(1))
            for i, doc_id in enumerate(ids):
                held += np.array([*encoder.encode(texts[i].as_py()), eod], "<u2").tobytes()
                pending.append((len(held), doc_id))
                while len(held) >= block:
                    yield emit(block)
        if held:
            yield emit(len(held))

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "file int, block bigint, data binary, first bigint, doc_ids array<bigint>")


def count_tokens(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens by writing token files and scanning them."""
    files = materialize(token_blocks(docs, path), "tokencount-files", "zstd")
    counted = scan_blocks(files.select("file", "block", "data"), next(iter(vocabulary(path).special.values())))
    manifest = files.select("file", "first", F.posexplode("doc_ids").alias("pos", "doc_id")).select("file", (F.col("first") + F.col("pos")).alias("ordinal"), "doc_id")
    return manifest.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens")


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
