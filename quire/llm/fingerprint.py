"""Document fingerprints: a threshold-scaled sketch (every shingle hash below a fixed fraction is kept).

Sketches of the same fraction merge by union, and the containment of one text in another is estimated by the share of
its kept hashes that the other keeps too, however unequal the two are. A fingerprint is text: the number of distinct
shingles and a digest of their set, then the kept hashes, 8 hex digits each, in order.

Defined results: a null text is empty and has the fingerprint of an empty set; texts of fewer than k words have one
shingle, the whole sequence; where neither sketch keeps a hash, likeness is 1 for equal sets and 0 otherwise; equal texts have
equal fingerprints. Rows of a repeated doc_id follow each other by text; a null doc_id comes last; a single row is its
own next document; very long texts are sketched whole, their fingerprints grow in proportion; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import append_columns, table, text_chunks
from quire.llm.hashing import U, mix, shingles, text_words

K = 5
#: A hash is kept if it is below 2**64 / SCALE.
SCALE_BITS = 2
#: Ranges of doc_id that the edit query deals out for each shuffle partition, and at most.
RANGES_EACH, RANGES_MOST = 4, 8192


def sketch(column: pa.Array, k: int = K) -> list[tuple[int, int, np.ndarray]]:
    """Set size, set digest and kept hashes (32 bits, ascending) of every text."""
    out = []
    for lo, hi, buf, offs in text_chunks(column):
        sets, at = shingles(*text_words(buf, offs), k)
        sums = np.zeros(len(sets) + 1, U)
        np.cumsum(mix(sets ^ U(0xC0FFEE)), out=sums[1:])
        digest = sums[at[1:]] - sums[at[:-1]]
        kept = sets < U(1 << (64 - SCALE_BITS))
        n = np.concatenate([[0], np.cumsum(kept)])[at]
        short = (sets[kept] >> U(32 - SCALE_BITS)).astype(np.uint32)
        for i in range(hi - lo):
            out.append((int(at[i + 1] - at[i]), int(digest[i]), short[n[i] : n[i + 1]]))
    return out


def to_text(one: tuple[int, int, np.ndarray]) -> str:
    return f"{one[0]}:{one[1]:016x}:{one[2].astype('>u4').tobytes().hex()}"


def from_text(fingerprint: str) -> tuple[int, int, np.ndarray]:
    n, digest, kept = fingerprint.split(":")
    return int(n), int(digest, 16), np.frombuffer(bytes.fromhex(kept), ">u4").astype(np.uint32)


def _common(x: np.ndarray, y: np.ndarray) -> int:
    both = np.sort(np.concatenate([np.unique(x), np.unique(y)]))
    return int((both[1:] == both[:-1]).sum())


def containment(x: tuple, y: tuple) -> float:
    """Estimated share of x's shingles that y has too."""
    if not len(x[2]) or x[:2] == y[:2]:
        return float(x[:2] == y[:2] or x[0] == 0)
    return _common(x[2], y[2]) / len(np.unique(x[2]))


def likeness(x: tuple, y: tuple) -> float:
    """Estimated similarity: shared kept hashes over all kept hashes."""
    if x[:2] == y[:2]:
        return 1.0
    if not len(x[2]) and not len(y[2]):
        return 0.0
    common = _common(x[2], y[2])
    return common / (len(np.unique(x[2])) + len(np.unique(y[2])) - common)


def merge(x: tuple, y: tuple) -> np.ndarray:
    """Kept hashes of the union of two texts' sets."""
    return np.union1d(x[2], y[2])


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with a column fingerprint."""
    return append_columns(docs, "text", lambda: lambda column: [pa.array([to_text(s) for s in sketch(column)], pa.string())], "fingerprint string")


def _range_of(key: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below the key (none for a null key): a search over blocks of cuts, then in one block."""
    width = max(1, math.isqrt(len(cuts)))
    blocks = [cuts[i : i + width] for i in range(0, len(cuts), width)] + [[]]
    below = lambda values: F.size(F.filter(values, lambda x: x <= key))
    longs = lambda values: F.array(*map(F.lit, values)).cast("array<bigint>")
    block = below(longs([b[-1] for b in blocks if len(b) == width]))
    return (block * width + below(F.get(F.array(*map(longs, blocks)), block))).cast("int")


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(part, doc_id, text, ghost): rows dealt by range of doc_id and sorted descending; each range ends with a copy (ghost)
    of the row that follows its last one, so neighbours are known without a window over the whole table.

    The driver sees at most ``ranges`` cuts and the largest doc_id of each range.
    """
    spark = docs.sparkSession
    ranges = ranges or min(RANGES_MOST, RANGES_EACH * int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    part = _range_of(F.col("doc_id"), cuts)
    tops = {r["part"]: r["top"] for r in ids.select(part.alias("part"), "doc_id").groupBy("part").agg(F.max("doc_id").alias("top")).collect()}
    filled = sorted(tops)
    # a range's first row in descending order follows the last row of the range above; the first of all follows the last of all
    above = {p: filled[(i + 1) % len(filled)] for i, p in enumerate(filled)}
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("part", part)
    at = lambda values, kind: F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("part"))
    every = range(len(cuts) + 1)
    heads = F.when(F.col("doc_id").eqNullSafe(at([tops.get(p) for p in every], "bigint")), at([above.get(p) for p in every], "int"))
    both = F.explode(F.when(heads.isNull(), F.array(F.struct("part", F.lit(False).alias("ghost")))).otherwise(F.array(F.struct("part", F.lit(False).alias("ghost")), F.struct(heads.alias("part"), F.lit(True).alias("ghost")))))
    dealt = rows.select("doc_id", "text", both.alias("x")).select("x.part", "x.ghost", "doc_id", "text")
    return dealt.repartition("part").sortWithinPartitions("part", "ghost", F.col("doc_id").desc_nulls_last(), "text")


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the following text's first (or all)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held: list = []  # the last row seen: part, id, text, sketch
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            rows = batch.slice(at, 1024)
            ids, texts = rows.column(2).to_pylist(), rows.column(3).to_pylist()
            parts, ghosts = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            marks = sketch(rows.column(3))
            line = held + list(zip(parts, ids, texts, marks, ghosts))
            done, news = [], []
            for own, nxt in zip(line, line[1:]):
                if own[0] == nxt[0] and not own[4]:
                    done.append((own, nxt))
                    news.append(edited(own[2], nxt[2]))
            held = line[-1:]
            if done:
                changed = sketch(pa.array(news, pa.string()))
                out = [(o[1], len(o[2]), hashlib.sha256(t.encode()).hexdigest(), to_text(o[3]), to_text(c), likeness(o[3], c), likeness(o[3], n[3])) for (o, n), t, c in zip(done, news, changed)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), *(pa.array(c) for c in list(zip(*out))[1:])], names)


def edit_probe(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how near both and the next document's are."""
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    ordered = with_next(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ranges)
    return ordered.mapInArrow(_edit, schema)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_probe(table(spark, sf_dir, "documents"))
