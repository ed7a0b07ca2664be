"""Near duplicates by fast similarity sketching, banding and exact verification.

A text's set is its distinct k-word shingles. The sketch fills t bins in rounds: in round i < t every element falls
into a random bin with value i + (0..1), in round t + j every element falls into bin j, so each bin is filled for
certain, early rounds win, and the number of equal bins is concentrated around the similarity. Round 0 reads the sorted
hashes directly; few texts need more than two or three rounds. Bins are banded; texts that share a band are
candidates, and a candidate pair becomes a link only when the full sets say so.

Texts with the same set are one class; only class representatives (least doc_id) are banded. Inside a bucket every
member is first checked against one leading member, and what is then still in different components is checked pair by
pair between components (quadratic in those that exact bounds leave, a join that can be split), so no link between components is lost. Before
that, members leave the bucket whose shingles that any other text has are too few for a link with any of its sizes.

Defined results: null, empty and wordless texts have an empty set and link with nothing; ties go to the smaller doc_id;
rows of a repeated doc_id share its component; a null doc_id has a null component and is kept; very long texts are
one set each, however many shingles it has; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import materialize, table, text_chunks
from quire.llm.graph import connected_components
from quire.llm.hashing import U, mix, shingles, text_words

#: Bins, rows of a band. A pair of similarity 0.8 shares no band with probability (1 - 0.8**4)**32 = 5e-8.
BINS, ROWS = 128, 4
BIN_BITS = 7
#: Bins of the one-byte sketch that must agree before sets are compared: the count expected at the threshold less 9 deviations.
SLACK = 9.0


def sketches(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The (texts, BINS) sketches of sorted distinct 64-bit hashes; rows of empty sets are undefined."""
    n = len(at) - 1
    out = np.full(n * BINS, np.iinfo(np.uint64).max, U)
    own = np.repeat(np.arange(n), np.diff(at))
    live, where = sets, own
    shift = U(64 - BIN_BITS)
    for turn in range(2 * BINS):
        if not len(live):
            break
        h = mix(live ^ mix(np.full(1, turn * 2 + 1, U)))
        bins = (h >> shift).astype(np.int64) if turn < BINS else np.full(len(h), turn - BINS)
        np.minimum.at(out, where * BINS + bins, (U(turn) << U(56)) | ((h << U(BIN_BITS)) >> U(8)))
        open_ = (out.reshape(n, BINS) == np.iinfo(np.uint64).max).any(axis=1)
        if not open_.all():
            keep = open_[where]
            live, where = live[keep], where[keep]
    return out.reshape(n, BINS)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    parts = mix(sketch).reshape(len(sketch), BINS // ROWS, ROWS)
    key = np.arange(1, BINS // ROWS + 1, dtype=U)[None, :] * U(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        key = mix(key * U(0xD6E8FEB86659FD93) + parts[:, :, j])
    return key.view(np.int64)


def _binary(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Binary column: row i holds the bytes of values[at[i]:at[i + 1]]."""
    data = np.ascontiguousarray(values).view(np.uint8)
    ends = pa.py_buffer((at * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, ends, pa.py_buffer(data)])


def _grouped_sum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values, out=sums[1:])
    return (sums[at[1:]] - sums[at[:-1]]).view(np.int64)


def sketch_documents(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (set size), d1, d2 (128-bit digest of the set), sig (low byte of each bin), bands (keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in text_chunks(batch.column(1)):
                sets, at = shingles(*text_words(buf, offs), k)
                sketch = sketches(sets, at)
                rows = np.arange(hi - lo + 1)
                width = BINS // ROWS
                low = (mix(sketch) & U(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at)),
                    pa.array(_grouped_sum(mix(sets ^ U(0x1234567)), at)), pa.array(_grouped_sum(mix(sets * U(0x9FB21C651E98DF25) + U(99)), at)),
                    _binary(low.ravel(), rows * BINS),
                    pa.ListArray.from_arrays(pa.array((rows * width).astype(np.int32)), pa.array(band_keys(sketch).ravel())),
                ], ["doc_id", "n", "d1", "d2", "sig", "bands"])

    schema = "doc_id bigint, n bigint, d1 bigint, d2 bigint, sig binary, bands array<bigint>"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id and the full set of its text, as sorted 64-bit hashes in one binary value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in text_chunks(batch.column(1)):
                sets, at = shingles(*text_words(buf, offs), k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), _binary(sets, at)], ["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, shingles binary")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, na, nb (sizes of the full sets) and common (size of their intersection) of the pairs (a, b)."""
    with_a = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    with_both = with_a.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = (np.frombuffer(v.as_buffer(), U) for v in (x, y))
                both = np.sort(np.concatenate([x, y]))
                out[:, i] = len(x), len(y), (both[1:] == both[:-1]).sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, out)], ["a", "b", "na", "nb", "common"])

    return with_both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint, na bigint, nb bigint, common bigint")


def linked(percent: int) -> str:
    return f"100 * common >= {percent} * (na + nb - common)"


def _alike(percent: int):
    """Cheap necessary conditions on (na, nb, ga, gb): sizes allow the threshold, and sketches don't rule it out."""
    j = percent / 100
    p = j + (1 - j) / 256
    least = BINS * p - SLACK * (BINS * p * (1 - p)) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(pa.concat_arrays([batch.column(i)]).buffers()[2], np.uint8, batch.num_rows * BINS).reshape(-1, BINS) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    return run


def candidates(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs that size and one-byte sketches leave; a pair at the threshold is lost with a probability under 1e-18."""
    side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"g{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return sized.select("a", "b", F.concat("ga", F.lit(b"")).alias("ga"), F.concat("gb", F.lit(b"")).alias("gb")).mapInArrow(_alike(percent), "a bigint, b bigint")


def shared_sizes(sets: DataFrame) -> DataFrame:
    """doc_id and alone, the number of its shingles that no other text of ``sets`` has (texts without any are left out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                ids, lists = batch.column(0).slice(i, 512).to_numpy(), [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column(1).slice(i, 512)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(v) for v in lists])), pa.array(np.concatenate(lists))], ["doc_id", "shingle"])

    flat = sets.select("doc_id", "shingles").mapInArrow(run, "doc_id bigint, shingle bigint")
    single = flat.groupBy("shingle").agg(F.count(F.lit(1)).alias("times"), F.min("doc_id").alias("doc_id")).where("times = 1")
    return single.groupBy("doc_id").agg(F.count(F.lit(1)).alias("alone"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    rows = materialize(sketch_documents(docs, k), "neardup-sketches")
    filled = rows.where("n > 0 and doc_id is not null")
    classes = materialize(filled.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")), "neardup-classes")
    reps = filled.join(classes.select(F.col("rep").alias("doc_id"), "n", "d1", "d2"), ["doc_id", "n", "d1", "d2"], "left_semi").dropDuplicates(["doc_id", "n", "d1", "d2"])
    reps = materialize(reps.withColumn("cid", F.col("doc_id")), "neardup-representatives")
    banded = reps.select("doc_id", F.explode("bands").alias("key"))
    # what is grouped by bucket is written before it is joined, so that the rows of a hot bucket can be split in the join
    leads = materialize(banded.groupBy("key").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).where("lead < last").select("key", "lead"), "neardup-leads")
    members = materialize(banded.join(leads, "key"), "neardup-members")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
    sets = materialize(shingle_sets(texts.join(members.select("doc_id").distinct(), "doc_id", "left_semi"), k).dropDuplicates(["doc_id"]), "neardup-sets")

    first = members.where("doc_id <> lead").groupBy("doc_id").agg(F.min("lead").alias("a")).select("a", F.col("doc_id").alias("b"))
    measured = materialize(overlaps(first, sets), "neardup-measured")
    links = materialize(measured.where(linked(percent)).select("a", "b"), "neardup-links")
    found = connected_components(links)

    # what a pair can share, exactly bounded: shingles that no other text has count for nothing (s is the rest), and two texts
    # measured against the same lead share at most the smaller part in the lead and the smaller part outside of it
    facts = (
        reps.select("doc_id", "n").join(shared_sizes(sets), "doc_id", "left").withColumn("s", F.col("n") - F.coalesce("alone", F.lit(0))).where(f"100 * s >= {percent} * n")
        .join(measured.select(F.col("b").alias("doc_id"), F.col("a").alias("lead"), "common"), "doc_id", "left")
        .select("doc_id", "n", "s", F.coalesce("lead", "doc_id").alias("lead"), F.coalesce("common", "n").alias("c"))
    )
    named = members.select("key", "doc_id").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("part")).join(facts, "doc_id")
    named = materialize(named, "neardup-named")
    least = materialize(named.groupBy("key").agg(F.min("n").alias("least"), F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("key", "least"), "neardup-least")
    able = materialize(named.join(least, "key").where(f"100 * s >= {percent} * (n + greatest(least, s) - s)").drop("least"), "neardup-able")
    # every pair between components has a side outside the bucket's largest component
    most = able.groupBy("key", "part").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.max(F.struct("m", "part")).alias("top"), F.count(F.lit(1)).alias("k")).where("k > 1").select("key", F.col("top.part").alias("big"))
    most = materialize(most, "neardup-most")
    split = materialize(able.join(most, "key").join(reps.select("doc_id", "bands"), "doc_id"), "neardup-split")
    side = lambda x: split.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("doc_id", "part", "n", "s", "lead", "c", "bands")], *["big"] * (x == "x"))
    common = "case when lead_x = lead_y then least(c_x, c_y) + least(s_x - c_x, s_y - c_y) else least(s_x, s_y, n_x, n_y) end"
    crossing = F.expr(f"part_x <> big and part_x <> part_y and (part_y = big or doc_id_x < doc_id_y) and doc_id_y <> lead_x and doc_id_x <> lead_y and 100 * ({common}) >= {percent} * (n_x + n_y - ({common}))")
    crossing = crossing & F.expr("filter(zip_with(bands_x, bands_y, (p, q) -> if(p = q, p, null)), v -> v is not null)[0] = key")  # once, in the first bucket they share
    x, y = side("x"), side("y").withColumnRenamed("key", "key_y")
    pairs = x.join(y, (F.col("key") == F.col("key_y")) & crossing).select(F.least("doc_id_x", "doc_id_y").alias("a"), F.greatest("doc_id_x", "doc_id_y").alias("b"))
    across = overlaps(candidates(pairs, reps, percent), sets).where(linked(percent)).select("a", "b")
    parted = connected_components(links.unionByName(across))

    of_class = classes.join(parted.withColumnRenamed("node", "rep"), "rep", "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    joined = rows.select("doc_id", "n", "d1", "d2").join(of_class, ["n", "d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id")).cast("bigint")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, percent=80)
