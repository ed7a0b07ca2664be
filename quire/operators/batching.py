"""Greedy ordered packing of blocks into translation batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.ordered import running
from quire.sources.scratch import keep

# Characters and blocks of a batch at most.
MAX_CHARS, MAX_BLOCKS = 24_000, 20


def batch_starts(sizes: Column, max_chars: int, max_blocks: int) -> Column:
    """Indexes (from 0) where batches start: a fold that carries counters and only grows its list at a new batch."""
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("chars"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, size: Column) -> Column:
        full = (acc["n"] == 0) | (acc["chars"] + size > max_chars) | (acc["n"] >= max_blocks)
        return F.struct(
            (acc["i"] + 1).alias("i"), (F.when(full, F.lit(0)).otherwise(acc["chars"]) + size).cast("bigint").alias("chars"),
            (F.when(full, F.lit(0)).otherwise(acc["n"]) + 1).alias("n"), F.when(full, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"),
        )

    return F.aggregate(sizes, zero, step)["starts"]


def row_starts(keys: list, ids: list[str], sizes: list[int], max_chars: int, max_blocks: int) -> list[int]:
    """The same starts over rows of many documents, in order of key and place: a batch ends with its document too, and before an id that
    it holds, as answers name ids."""
    starts, chars, held = [], 0, set()
    for i, (key, block, size) in enumerate(zip(keys, ids, sizes)):
        if not starts or key != keys[starts[-1]] or chars + size > max_chars or len(held) >= max_blocks or block in held:
            starts.append(i)
            chars, held = 0, set()
        chars += size
        held.add(block)
    return starts


def plan_batches(blocks: DataFrame, max_chars: int = MAX_CHARS, max_blocks: int = MAX_BLOCKS, split: int | None = None) -> DataFrame:
    """doc_id, batch_no, id, block_ids, char_count from (doc_id, pos, id, size), in order of pos; a block over the limit is alone.

    A document is one array, unless ``split`` says after how many blocks it is cut (see :func:`plan_pieces`).
    """
    if split:
        return plan_pieces(blocks, max_chars, max_blocks, split)
    lists = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id", F.col("size").cast("bigint").alias("size")))).alias("all"))
    cut = lists.withColumn("starts", batch_starts(F.transform("all", lambda b: b["size"]), max_chars, max_blocks))
    each = cut.select("doc_id", "all", "starts", F.posexplode("starts").alias("no", "start"))
    end = F.coalesce(F.get("starts", F.col("no") + 1), F.size("all"))
    part = F.slice("all", F.col("start") + 1, end - F.col("start"))
    return each.select(
        "doc_id", (F.col("no") + 1).alias("batch_no"), F.format_string("batch-%03d", F.col("no") + 1).alias("id"), F.transform(part, lambda b: b["id"]).alias("block_ids"),
        F.aggregate(part, F.lit(0).cast("bigint"), lambda a, b: a + b["size"]).alias("char_count"),
    )


def successors(sizes: np.ndarray, max_chars: int, max_blocks: int) -> np.ndarray:
    """Where the next batch starts if one starts at each block."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(len(sizes))
    return np.maximum(at + 1, np.minimum(at + max_blocks, np.searchsorted(sums, sums[:-1] + max_chars, side="right") - 1))


def plan_pieces(blocks: DataFrame, max_chars: int, max_blocks: int, split: int) -> DataFrame:
    """:func:`plan_batches` of documents of any length: pieces of ``split`` blocks are tasks of their own.

    A piece, with as many of the next piece's blocks as a batch can reach, is a map: if the first batch in it starts at its block e
    (fewer than ``max_blocks`` are possible), the first one of the next piece starts at block f, and so many start in it. The maps of a
    document, one short row each, are run through in order; then each piece, knowing its e, makes its own batches. doc_id isn't null.
    """
    if split < max_blocks:
        raise ValueError("a piece must hold a batch")
    rows = blocks.select("doc_id", "pos", "id", F.col("size").cast("bigint").alias("size"))
    placed = running(rows, "doc_id", ["pos"], []).withColumn("piece", F.floor((F.col("nth") - 1) / split)).drop("part")
    ahead = placed.where((F.col("piece") > 0) & ((F.col("nth") - 1) % split < max_blocks)).withColumn("piece", F.col("piece") - 1)
    pieces = keep(placed.withColumn("own", F.lit(True)).unionByName(ahead.withColumn("own", F.lit(False))), "pieces")
    doc = blocks.schema["doc_id"].dataType.simpleString()

    def steps(table: pa.Table) -> tuple[pa.Table, int, np.ndarray]:
        table = table.sort_by("nth").combine_chunks()
        return table, int(table["own"].to_numpy().sum()), successors(table["size"].to_numpy(), max_chars, max_blocks)

    def chart(table: pa.Table) -> pa.Table:
        table, own, after = steps(table)
        to, count = np.arange(len(after) + max_blocks + 1), np.zeros(len(after) + max_blocks + 1, np.int64)
        for i in range(own - 1, -1, -1):
            to[i], count[i] = to[after[i]], count[after[i]] + 1
        return pa.table({"doc_id": table["doc_id"][:1], "piece": table["piece"][:1], "to": pa.array([(to[:max_blocks] - own).tolist()], pa.list_(pa.int64())), "n": pa.array([count[:max_blocks].tolist()], pa.list_(pa.int64()))})

    charts = pieces.groupBy("doc_id", "piece").applyInArrow(chart, f"doc_id {doc}, piece bigint, to array<bigint>, n array<bigint>")
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("no"), F.array().cast("array<struct<piece:bigint,at:bigint,no:bigint>>").alias("seen"))

    def follow(acc: Column, c: Column) -> Column:
        here = F.struct(c["piece"].alias("piece"), acc["at"].alias("at"), acc["no"].alias("no"))
        at = acc["at"].cast("int")
        return F.struct(F.greatest(F.lit(0).cast("bigint"), F.get(c["to"], at)).alias("at"), (acc["no"] + F.get(c["n"], at)).alias("no"), F.concat(acc["seen"], F.array(here)).alias("seen"))

    runs = charts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("piece", "to", "n"))).alias("all"))
    known = keep(runs.select("doc_id", F.explode(F.aggregate("all", zero, follow)["seen"]).alias("s")).select("doc_id", "s.*"), "starts")

    def batches(table: pa.Table) -> pa.Table:
        table, own, after = steps(table)
        at, no = table["at"][0].as_py(), table["no"][0].as_py()
        starts = []
        while at < own:
            starts.append(at)
            at = int(after[at])
        sums = np.concatenate([[0], np.cumsum(table["size"].to_numpy())])
        ends = after[starts] if starts else np.zeros(0, np.int64)
        ids = table["id"].combine_chunks()
        inside = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends)]) if starts else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(ends - np.array(starts, np.int64))]), pa.int32()), ids.take(pa.array(inside)))
        return pa.table({"doc_id": pa.repeat(table["doc_id"][0], len(starts)), "batch_no": pa.array(range(no + 1, no + 1 + len(starts)), pa.int64()), "block_ids": lists, "char_count": pa.array(sums[ends] - sums[np.array(starts, np.int64)] if starts else [], pa.int64())})

    made = pieces.join(known, ["doc_id", "piece"]).groupBy("doc_id", "piece").applyInArrow(batches, f"doc_id {doc}, batch_no bigint, block_ids array<string>, char_count bigint")
    return made.select("doc_id", F.col("batch_no").cast("int").alias("batch_no"), F.format_string("batch-%03d", "batch_no").alias("id"), "block_ids", "char_count")
