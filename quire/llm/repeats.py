"""Removal of long passages that occur more than once, byte for byte, anywhere in the corpus.

Two steps keep the work distributed and exact:

1. Minimum anchors. Every window of ``length`` bytes is assigned to its least-hashed k-gram (its anchor). Equal windows
   have equal anchors, so windows can only repeat inside the group of their anchor's hash. Neighbouring windows with the
   same anchor form one context, a short byte string; only a few numbers of each context are shuffled. Contexts that
   occur whole more than once are decided by their count alone, however hot they are.
2. Run-length index. The distinct contexts of anchors that have several are indexed together, in bounded groups, by a
   run-compressed Burrows-Wheeler transform: symbol and length of every run, and the text positions sampled at its two
   ends. Matching statistics (the longest match elsewhere of what starts at each byte) are measured between the ends of
   neighbouring runs only and streamed over the text: inside a run a match extends to the left, so a value is its
   left neighbour's less one. Starts with a match of at least ``length`` bytes are marked.
   An anchor whose distinct contexts outgrow a group is never gathered: its windows are counted by hash, salted by
   nothing but their own content, which gives the same marks.

Defined results: null texts are empty, texts shorter than ``length`` keep everything; repeated rows count as
occurrences of each other; strings are judged on the input; an empty table gives an empty result; other columns are
ignored or pass through by position, whatever their names. Context equality rests on two 64-bit hashes: with a million
million distinct contexts, the odds that any two of them are taken for equal are below 2e-15.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import materialize, table, text_array, text_chunks
from quire.llm.hashing import NOT_SPACE, U, mix, prefix, ranges

LENGTH = 400
GRAM = 100
#: Bytes of a piece that very long texts are cut into (windows never are); context bytes of an index group.
PIECE, GROUP_BYTES = 1 << 22, 2_000_000
#: Context bytes of one anchor above which its windows are told apart one by one, by hash, instead of in one group.
HOT_BYTES = 8_000_000
#: Partitions of index groups at most.
TASKS = 20_000
_PLACE = (1 << 23) - 1


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, in two running minima over blocks."""
    n = len(keys)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, U)
    padded[:n] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def contexts(buf: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text number, place, number of windows, anchor hash and content hash of every context of some texts."""
    width = length - gram + 1
    sizes = np.diff(offs)
    if len(buf) < length or not (sizes >= length).any():
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    sums = prefix(buf)
    at = np.arange(len(buf) - gram + 1)
    hashes = ranges(sums, at, at + gram)
    least = sliding_min((hashes & ~U(_PLACE)) | at.astype(U), width)
    edge = np.zeros(len(buf) + 1, np.int8)
    long = sizes >= length
    edge[offs[:-1][long]] += 1
    edge[(offs[1:] - length + 1)[long]] -= 1
    starts = np.flatnonzero(np.cumsum(edge[: len(least)], dtype=np.int8))
    anchor = (least[starts] & U(_PLACE)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    lo, n = starts[first], np.diff(np.append(first, len(starts)))
    content = mix(ranges(sums, lo, lo + n + length - 1) ^ (n.astype(U) * U(0x9E3779B97F4A7C15)))
    return np.searchsorted(offs, lo, side="right") - 1, lo, n, hashes[anchor[first]].view(np.int64), content.view(np.int64)


def find_contexts(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """k, k2 (of the text), lo, n, a (anchor), c (content), times.

    What a chunk of texts can decide is decided there, so that a hot passage never travels as rows: a context that occurs
    several times in the chunk is one row with its count, and its occurrences are ranges of starts that are settled (times 0).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, buf, offs in text_chunks(batch.column(2)):
                whole = len(buf) <= PIECE
                for s in [0] if whole else range(0, len(buf) - length + 1, PIECE):
                    part = buf if whole else buf[s : s + PIECE + length - 1]
                    own, lo, n, a, c = contexts(part, offs if whole else np.array([0, len(part)]), length, gram)
                    order = np.lexsort((lo, c, a))
                    new = np.ones(len(order), bool)
                    new[1:] = (a[order][1:] != a[order][:-1]) | (c[order][1:] != c[order][:-1])
                    heads = np.flatnonzero(new)
                    times = np.diff(np.append(heads, len(order)))
                    one = order[heads]
                    many = np.sort(order[np.repeat(times, times) > 1])  # in order of place
                    join = np.ones(len(many), bool)
                    join[1:] = (own[many][1:] != own[many][:-1]) | (lo[many][1:] != lo[many][:-1] + n[many][:-1])
                    edge = np.flatnonzero(join)
                    many_n = np.add.reduceat(n[many], edge) if len(edge) else n[many]
                    at, none = many[edge], np.zeros(len(edge), np.int64)
                    rows = np.concatenate([one, at])
                    where = pa.array(own[rows] + first)
                    values = ((lo - offs[own])[rows] + s, np.concatenate([n[one], many_n]), np.concatenate([a[one], none]), np.concatenate([c[one], none]), np.concatenate([times, none]))
                    kinds = (np.int32, np.int32, np.int64, np.int64, np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), *(pa.array(v.astype(t)) for v, t in zip(values, kinds))], ["k", "k2", "lo", "n", "a", "c", "times"])

    return keyed.select("k", "k2", "text").mapInArrow(run, "k bigint, k2 int, lo int, n int, a bigint, c bigint, times bigint")


class RunLengthIndex:
    """Run-compressed BWT of several strings: symbols and lengths of the runs, text positions sampled at their first and
    last ranks, and the common prefix across every border of two runs.

    Prefix doubling sorts the suffixes; the ranks of every depth are a ladder that gives the common prefix of two
    suffixes in a few steps. Order and ladder are only needed to build the index and are not kept.
    """

    def __init__(self, strings: list[np.ndarray]):
        sizes = np.array([len(s) for s in strings])
        self.base = np.concatenate([[0], np.cumsum(sizes + 1)])
        text = np.zeros(self.base[-1], np.int16)  # 0 ends every string, bytes are 1..256
        for s, at in zip(strings, self.base):
            text[at : at + len(s)] = s
            text[at : at + len(s)] += 1
        n = self.n = len(text)
        left = (np.repeat(self.base[1:] - 1, sizes + 1) - np.arange(n)).astype(np.int32)  # bytes up to the string's end
        depth = 7
        packed = np.zeros(n, U)
        for j in range(depth):
            packed <<= U(9)
            packed[: n - j] |= text[j:].astype(U)
        order, rank = self._ranked(packed)
        ladder = [(depth, rank)]
        reach = int(sizes.max(initial=0)) + 1
        while rank[order[-1]] < n - 1:  # to the last tie: run borders are only exact in a total order
            key = rank.astype(U) << U(32)
            key[: n - min(depth, n)] |= (rank[depth:] + 1).astype(U)
            order, rank = self._ranked(key)
            depth *= 2
            if depth < reach:
                ladder.append((depth, rank))
        before = text[order - 1]
        new = np.ones(n, bool)
        new[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)  # a string's first byte extends no match to the left
        first = np.flatnonzero(new)
        last = np.append(first[1:], n) - 1
        self.run_symbols, self.run_lengths = before[first], last - first + 1
        self.heads, self.tails = order[first], order[last]
        self.borders = self._common(text, left, ladder, self.heads[1:], self.tails[:-1])

    @staticmethod
    def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys)
        sorted_ = keys[order]
        new = np.zeros(len(keys), np.int32)
        np.cumsum(sorted_[1:] != sorted_[:-1], out=new[1:], dtype=np.int32)
        rank = np.empty(len(keys), np.int32)
        rank[order] = new
        return order, rank

    @staticmethod
    def _common(text: np.ndarray, left: np.ndarray, ladder: list, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common prefixes of suffix pairs inside their strings: down the ladder, then byte by byte below its first step."""
        most, top = np.minimum(left[x], left[y]), len(text) - 1
        out = np.zeros(len(x), np.int64)
        for depth, rank in reversed(ladder):
            out += depth * (rank[np.minimum(x + out, top)] == rank[np.minimum(y + out, top)])
        live = np.flatnonzero(out < most)
        for _ in range(ladder[0][0] - 1):
            own = out[live]
            live = live[text[np.minimum(x[live] + own, top)] == text[np.minimum(y[live] + own, top)]]
            out[live] += 1
        return np.minimum(out, most)

    def matching_statistics(self) -> np.ndarray:
        """For each byte, the longest string starting there that also starts elsewhere.

        A suffix shares most with a neighbour in order. What the first of a run shares with the suffix before it, and the
        last with the one after, stands at the run's border; any other suffix and that neighbour are preceded by the same
        byte, and so are neighbours one byte to the left: the value is the left one's less one.
        """
        at = np.arange(self.n)
        out = np.zeros(self.n, np.int64)
        for sampled in (self.heads[1:], self.tails[:-1]):
            shared = np.zeros(self.n, np.int64)
            shared[sampled] = self.borders
            np.maximum(out, np.maximum.accumulate(shared + at) - at, out=out)
        return out

    def long_starts(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """String number, first and last start of every run of starts with a match of at least ``length`` bytes."""
        hit = self.matching_statistics() >= length
        edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        own = np.searchsorted(self.base, lo, side="right") - 1
        return own, lo - self.base[own], hi - self.base[own]


def _slices(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(4)
            flat, ends = wanted.flatten(), wanted.offsets.to_numpy() - wanted.offsets[0].as_py()
            lo, n, bucket = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            texts = text_array(batch.column(1))
            out: list[list] = [[], [], [], [], []]
            size = 0
            for i in range(batch.num_rows):
                data = texts[i].as_buffer()
                for j in range(ends[i], ends[i + 1]):
                    piece = data[int(lo[j]) : int(lo[j]) + int(n[j]) + length - 1].to_pybytes()
                    for col, v in zip(out, (batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), int(lo[j]), int(bucket[j]), piece)):
                        col.append(v)
                    size += len(piece)
                    if size > 1 << 23:
                        yield _slice_batch(out)
                        out, size = [[], [], [], [], []], 0
            yield _slice_batch(out)

    return run


def _slice_batch(out: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], ["k", "k2", "lo", "bucket", "content"])


def _marks(length: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("k", "ascending"), ("lo", "ascending")])
        index = RunLengthIndex([np.frombuffer(v.as_buffer(), np.uint8) for v in group["content"].chunk(0)])
        own, lo, hi = index.long_starts(length)
        rows = pa.array(own)
        base = group["lo"].to_numpy()[own]
        return pa.table({"k": group["k"].take(rows), "k2": group["k2"].take(rows), "s": pa.array((base + lo).astype(np.int32)), "e": pa.array((base + hi).astype(np.int32))})

    return run


def text_key() -> tuple[Column, Column]:
    """A 96-bit key of a row: its id and whole text."""
    text = F.coalesce("text", F.lit(""))
    return F.xxhash64(F.col("doc_id"), text).alias("k"), F.hash(text).alias("k2")


def repeated_starts(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """k, k2, s, e: runs of byte positions where a string of ``length`` bytes starts that also starts elsewhere."""
    found = materialize(find_contexts(keyed, length, gram), "repeats-contexts")
    # anchors are counted with partial sums, and those of a single row end here; what is joined by anchor or context is read
    # from written tables, so that the rows of a hot one can be split over tasks
    rows = found.where("times > 0")
    anchors = rows.groupBy("a").agg(F.count(F.lit(1)).alias("rows"), F.min("c").alias("p"), F.max("c").alias("q")).where("rows > 1")
    anchors = materialize(anchors.select("a", (F.col("p") < F.col("q")).alias("several")), "repeats-anchors")
    live = materialize(rows.join(anchors, "a"), "repeats-live")
    counts = live.groupBy("a", "c").agg(F.sum("times").alias("total"), F.min(F.struct("k", "k2", "lo")).alias("one"))
    dealt = live.join(materialize(counts, "repeats-counts"), ["a", "c"]).withColumn("first", F.struct("k", "k2", "lo") == F.col("one")).drop("one")
    kept = materialize(dealt.where("total > 1 and times = 1 or several and first"), "repeats-kept")
    whole = found.where("times = 0").select("k", "k2", "lo", "n").unionByName(kept.where("total > 1 and times = 1").select("k", "k2", "lo", "n"))
    whole = whole.select("k", "k2", F.col("lo").alias("s"), (F.col("lo") + F.col("n") - 1).alias("e"))
    wanted = kept.where("several and first").select("a", "k", "k2", "lo", "n")
    heavy = wanted.groupBy("a").agg(F.sum(F.col("n") + F.lit(length - 1)).alias("bytes")).where(F.col("bytes") > HOT_BYTES).select("a")
    heavy = materialize(heavy, "repeats-heavy")
    hot, cool = None, wanted
    if heavy.limit(1).count():
        hot, cool = materialize(wanted.join(heavy, "a", "left_semi"), "repeats-hot"), wanted.join(heavy, "a", "left_anti")
    size = wanted.agg(F.sum(F.col("n") + F.lit(length - 1))).first()[0] or 0
    groups = int(size // GROUP_BYTES) + 1
    pieces = _pieces(keyed, cool, F.pmod(F.xxhash64("a"), F.lit(groups)), length).repartition(min(TASKS, 2 * groups), "bucket")  # few bytes, long to index
    marked = pieces.groupBy("bucket").applyInArrow(_marks(length), "k bigint, k2 int, s int, e int")
    found = whole.unionByName(marked)
    return found if hot is None else found.unionByName(_hot_starts(keyed, hot, length))


def _pieces(keyed: DataFrame, wanted: DataFrame, bucket: Column, length: int) -> DataFrame:
    """k, k2, lo, bucket, content of the wanted contexts, cut out of their texts."""
    lists = wanted.groupBy("k", "k2").agg(F.collect_set(F.struct("lo", "n", bucket.alias("bucket"))).alias("wanted"))
    joined = keyed.join(lists, ["k", "k2"]).select("doc_id", "text", "k", "k2", "wanted")
    return joined.mapInArrow(_slices(length), "k bigint, k2 int, lo int, bucket bigint, content binary")


def _hot_starts(keyed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Marks of contexts whose anchor is too hot for one group: windows counted by (anchor, hash), one start a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column(4)[i].as_buffer(), np.uint8)
                at = np.arange(len(data) - length + 1)
                hashes = ranges(prefix(data), at, at + length).view(np.int64)
                same = lambda v, t: pa.array(np.full(len(at), v), t)
                k, k2, lo, bucket = (batch.column(j)[i].as_py() for j in range(4))
                yield pa.RecordBatch.from_arrays([same(k, pa.int64()), same(k2, pa.int32()), pa.array((at + lo).astype(np.int32)), same(bucket, pa.int64()), pa.array(hashes)], ["k", "k2", "s", "a", "w"])

    windows = materialize(_pieces(keyed, wanted, F.xxhash64("a"), length).mapInArrow(run, "k bigint, k2 int, s int, a bigint, w bigint"), "repeats-windows")
    again = windows.groupBy("a", "w").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("a", "w")
    return windows.join(again, ["a", "w"], "left_semi").select("k", "k2", "s", F.col("s").alias("e"))


def _words_in(data: memoryview, x: int, y: int) -> int:
    """Words that begin between two places of a text (what is left of a word at the first place counts)."""
    solid = NOT_SPACE[np.frombuffer(data[x:y], np.uint8)]
    return int(solid[:1].sum() + (solid[1:] & ~solid[:-1]).sum())


def _cut(length: int, texts_out: bool, words: int = 0):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, spans = text_array(batch.column(1)), batch.column(2)
            filled = spans.offsets.to_numpy() - spans.offsets[0].as_py()
            flat = spans.flatten()
            s, e = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            out = []
            for i in range(batch.num_rows):
                data = memoryview(texts[i].as_buffer())
                lo, hi = s[filled[i] : filled[i + 1]], e[filled[i] : filled[i + 1]] + length
                order = np.argsort(lo)
                lo, hi = lo[order], np.maximum.accumulate(hi[order]) if len(hi) else hi
                new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]])) if len(lo) else np.zeros(0, np.int64)
                starts, ends = lo[new], hi[np.append(new[1:], len(lo)) - 1] if len(lo) else hi
                if words and len(starts):
                    long = np.array([_words_in(data, x, y) >= words for x, y in zip(starts.tolist(), ends.tolist())])
                    starts, ends = starts[long], ends[long]
                kept, digest, at = [], hashlib.sha256(), 0
                for x, y in zip(starts.tolist(), ends.tolist()):
                    digest.update(data[at:x])
                    kept.append(data[at:x])
                    at = y
                digest.update(data[at:])
                kept.append(data[at:])
                row = [len(data), int((ends - starts).sum()), len(starts), digest.hexdigest()]
                out.append((*row, b"".join(kept).decode("utf-8", "ignore")) if texts_out else row)
            cols = [pa.array(c) for c in zip(*out)]
            keep = [batch.column(0)] if not texts_out else list(batch.columns[3:])
            yield pa.RecordBatch.from_arrays([*keep, *cols], [f"c{i}" for i in range(len(keep) + len(cols))])

    return run


def _with_spans(docs: DataFrame, length: int, gram: int = GRAM) -> DataFrame:
    keyed = docs.select(*[F.col(c) for c in docs.columns], *text_key())
    starts = repeated_starts(keyed.select("doc_id", "text", "k", "k2"), length, gram)
    lists = starts.groupBy("k", "k2").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    return keyed.join(lists, ["k", "k2"], "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<s:int,e:int>>")))


def repeated_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    rows = _with_spans(docs.select("doc_id", "text"), length).select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = rows.mapInArrow(_cut(length, False), f"c0 {kind}, c1 bigint, c2 bigint, c3 bigint, c4 string")
    return cut.toDF("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, words: int = 0) -> DataFrame:
    """``docs`` with the repeated bytes taken out of text (a character cut in part goes whole).

    With ``words``, a maximal run of repeated bytes stays if fewer words than that begin in it.
    """
    names = docs.columns
    at = names.index("text")
    inner = [f"q{i}" for i in range(len(names))]
    wide = docs.toDF(*inner)
    slim = wide.select("*", F.col(inner[names.index("doc_id")]).alias("doc_id"), F.col(f"q{at}").alias("text")).drop(f"q{at}")
    rest = [c for c in inner if c != f"q{at}"]
    rows = _with_spans(slim, length, gram).select("doc_id", "text", "spans", *rest)
    kinds = [wide.schema[c].dataType.simpleString() for c in rest]
    schema = ", ".join(f"c{i} {t}" for i, t in enumerate([*kinds, "bigint", "bigint", "bigint", "string", "string"]))
    cut = rows.mapInArrow(_cut(length, True, words), schema)
    placed = dict(zip(rest, (f"c{i}" for i in range(len(rest))))) | {f"q{at}": f"c{len(rest) + 4}"}
    return cut.select(*[F.col(placed[c]).alias(n) for c, n in zip(inner, names)])


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
