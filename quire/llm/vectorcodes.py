"""Vector code compression: product codes in whole numbers, the same on any machine and in any order of the rows.

Components become integers (floor of ``SCALE`` times the component), vectors are cut into parts, and each part position
has a codebook that a fixed number of rounds refine: every part goes to its nearest entry, every entry becomes the floor
of the mean of its parts. All distances are exact, but few are computed so: one float32 matrix product screens a batch,
every entry gets an interval that holds its true distance whatever the order of summation (Higham's bound on inner
products, rounding of the factors included), and only entries whose interval reaches the best one's upper end are
evaluated again in int64; ties go to the lower index.

A round is one pass over the vectors: tasks add up the parts of each entry in bounded arrays, one row for each component
of a codebook and task is shuffled, and the driver holds the codebooks alone (``ENTRIES`` vectors, as a parameter of the
next pass). Nothing is grouped by vector or label before the sums are combined.

Defined results: rows whose vector is null or holds null or non-finite components are left out, as are vectors without
components and those of another length than the smallest vec_id's, which have no such parts; where a length isn't a
multiple of the parts, their borders are at its multiples rounded down; of several vectors of a vec_id the least starts an
entry, rows without vec_id start entries last; fewer vec_ids than entries make smaller codebooks; repeated rows count
and are coded each; integers whose squared distances 64 bits couldn't add up are held to the largest that they could;
an empty table gives an empty result; other columns pass through, but those named code or error give way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm._common import append_columns, materialize, table

#: Fixed by op11's contract: steps of a unit, parts of a vector, entries of a codebook, rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Unit roundoffs of float32 and float64.
_U32, _U64 = 2.0**-24, 2.0**-53
_HEX = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), np.uint8).reshape(256, 2)


def borders(dim: int, parts: int = PARTS) -> list[int]:
    return [dim * i // parts for i in range(parts + 1)]


def integers(column: pa.Array, dim: int | None = None, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable rows of ``dim`` components in a list column, and their integers (rows, dim)."""
    right = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == dim)
    flat = column.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(right), dim)
    finite = np.isfinite(flat).all(axis=1)  # a null component is not a number here
    most = float(int(np.sqrt(2.0**62 / dim)) // 2)
    with np.errstate(over="ignore"):
        return right[finite], np.clip(np.floor(flat[finite] * scale), -most, most).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of each row's nearest entry (ties: the lower one), its exact squared distance, and how many entries were evaluated again."""
    width = x.shape[1]
    gamma = (width + 2) * _U32 / (1 - (width + 2) * _U32)
    squares = (book * book).sum(axis=1).astype(np.float64)
    reach = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))[:, None] * np.sqrt(squares)[None, :] * (1 + 2.0**-40)
    rough = squares[None, :] - 2.0 * (x.astype(np.float32) @ book.T.astype(np.float32)).astype(np.float64)
    slack = 2.0 * gamma * reach + 8 * _U64 * (squares[None, :] + 2.0 * reach)
    open_ = rough - slack <= (rough + slack).min(axis=1, keepdims=True)
    code = open_.argmax(axis=1)
    unsure = np.flatnonzero(open_.sum(axis=1) > 1)
    again = 0
    if len(unsure):
        row, entry = np.nonzero(open_[unsure])
        exact = np.full((len(unsure), len(book)), np.iinfo(np.int64).max)
        exact[row, entry] = ((x[unsure[row]] - book[entry]) ** 2).sum(axis=1)
        code[unsure] = exact.argmin(axis=1)
        again = len(row)
    return code, ((x - book[code]) ** 2).sum(axis=1), again


def _starts(vectors: DataFrame, entries: int, scale: int) -> list[list[int]]:
    """The integer vectors of the smallest vec_ids, from at most ``entries`` rows a task and length of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, dict[tuple[bool, int], tuple[int, ...]]] = {}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            lengths = pc.fill_null(pc.list_value_length(batch.column(1)), 0)
            for dim in pc.unique(lengths).to_pylist():
                if dim:
                    rows, x = integers(batch.column(1), dim, scale)
                    held = least.setdefault(dim, {})
                    order = sorted(range(len(rows)), key=lambda i: (ids[rows[i]] is None, ids[rows[i]] or 0))
                    seen: set = set()
                    for i in order:
                        key = (ids[rows[i]] is None, ids[rows[i]] or 0)
                        seen.add(key)
                        if len(seen) > entries:
                            break
                        v = tuple(x[i].tolist())
                        held[key] = min(held.get(key, v), v)
                    least[dim] = dict(sorted(held.items())[:entries])
        out = [(None if k[0] else k[1], dim, v) for dim, held in least.items() for k, v in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["vec_id", "dim", "v"])

    found = materialize(vectors.mapInArrow(run, "vec_id bigint, dim bigint, v array<bigint>"), "codes-starts")
    merged = found.groupBy("dim", "vec_id").agg(F.min("v").alias("v"))
    order = [F.asc_nulls_last("vec_id"), F.asc("v")]
    first = merged.orderBy(*order).first()
    return [r.v for r in merged.where(F.col("dim") == first.dim).orderBy(*order).limit(entries).collect()] if first else []


def _means(vectors: DataFrame, books: list[np.ndarray], cuts: list[int], scale: int) -> list[np.ndarray]:
    """The next codebooks: the floor of each entry's mean; an entry without parts stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros(b.shape, np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            _, x = integers(batch.column(0), cuts[-1], scale)
            for p, book in enumerate(books):
                part = x[:, cuts[p] : cuts[p + 1]]
                code = nearest(part, book)[0]
                for e in np.unique(code):
                    own = part[code == e]
                    sums[p][e] += own.sum(axis=0)
                    counts[p][e] += len(own)
        rows = [(p, e, i, int(v), int(counts[p][e])) for p, s in enumerate(sums) for e in np.flatnonzero(counts[p]).tolist() for i, v in enumerate(s[e])]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], ["part", "entry", "place", "total", "n"])

    added = vectors.mapInArrow(run, "part bigint, entry bigint, place bigint, total bigint, n bigint")
    total = added.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n"))
    new = [b.copy() for b in books]
    for r in total.collect():  # as many numbers as the codebooks have
        new[r.part][r.entry][r.place] = int(r.total) // r.n
    return new


def codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """One integer array (entries, width) for each part of ``vectors`` (vec_id, embedding); empty without usable vectors."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's index must fit in a byte")
    starts = _starts(vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding"), entries, scale)
    if not starts:
        return []
    first = np.array(starts, np.int64)
    cuts = borders(first.shape[1], parts)
    books = [first[:, a:b].copy() for a, b in zip(cuts, cuts[1:])]
    for _ in range(rounds):
        books = _means(vectors.select("embedding"), books, cuts, scale)
    return books


def encode(vectors: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """The usable rows of ``vectors`` with code (two hex digits a part) and error (squared distances summed over parts)."""
    own = [c for c in vectors.columns if c.lower() not in ("code", "error")]
    fields = [vectors.schema[c].dataType for c in own] + [T.StringType(), T.LongType()]
    schema = T.StructType([T.StructField(f"c{i}", t) for i, t in enumerate(fields)])
    at, cuts = own.index("embedding"), [0, *np.cumsum([b.shape[1] for b in books]).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not books:
                continue
            rows, x = integers(batch.column(at), cuts[-1], scale)
            codes, error = np.zeros((len(rows), len(books)), np.uint8), np.zeros(len(rows), np.int64)
            for p, book in enumerate(books):
                codes[:, p], far, _ = nearest(x[:, cuts[p] : cuts[p + 1]], book)
                error += far
            width = 2 * len(books)
            offsets = pa.py_buffer(np.arange(0, width * (len(rows) + 1), width, dtype=np.int32))
            code = pa.StringArray.from_buffers(len(rows), offsets, pa.py_buffer(np.ascontiguousarray(_HEX[codes])))
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, code, pa.array(error)], schema.names)

    named = vectors.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(own)])
    return named.mapInArrow(run, schema).toDF(*own, "code", "error")


def decode(coded: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """``coded`` with approximate: each part's entry in the original unit, in the middle of its step; null where code is no code of these books."""

    def make():
        middle = [(b + 0.5) / scale for b in books]

        def work(codes: pa.Array) -> list[pa.Array]:
            good = [len(c) == 2 * len(books) for c in codes.to_pylist()]
            at = np.frombuffer(bytes.fromhex("".join(c for c, ok in zip(codes.to_pylist(), good) if ok)), np.uint8).reshape(-1, len(books))
            near = iter(np.concatenate([m[at[:, p]] for p, m in enumerate(middle)], axis=1).tolist())
            return [pa.array([next(near) if ok else None for ok in good], pa.list_(pa.float64()))]

        return work

    return append_columns(coded, "code", make, "approximate array<double>")


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components, by part, entry and place."""
    return hashlib.sha256(",".join(str(v) for b in books for row in b.tolist() for v in row).encode()).hexdigest()


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = codebooks(vectors)
    coded = materialize(encode(vectors, books).drop("embedding"), "codes")
    longest = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums = materialize(coded.groupBy(F.col("label").alias("_label")).agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")).cast("decimal(38,0)"), longest).cast("bigint").alias("label_error")), "codes-labels")
    met = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
