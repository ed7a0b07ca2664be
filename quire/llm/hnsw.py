"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, kept as flat neighbour arrays.

Largest inner product becomes least distance by one more coordinate, sqrt(M**2 - |x|**2) with M the shard's longest
norm, so the graphs are metric for vectors of any length. Equal vectors are one node that keeps the smallest ids, as
many as a result can use. Shard results are scored again in double precision on the original vectors and merged. Query
rows are a stated set (ids divisible by ``every``) and go to the shards.

Shards grow with the table, so that a query visits ``EVERYWHERE`` of them at most: its work then grows like a graph's
depth. Where shards reach ``BYTES`` of vectors and there would be more of them, rows are dealt to cells by their nearest
centre (k-means over a bounded sample; every row is indexed, cells are split into shards of that size) and a query
visits the cells nearest to it, as many as hold ``REACH`` of the neighbours inside the sample. Vectors without any
structure then need most of the cells.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part;
vectors of another length than the query's are no candidates; ties go to the smaller id; fewer candidates than ``k`` are all returned; rows of a repeated id count once, by their nearest vector (as a query: by the least); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm._common import materialize, table

#: Nodes of a shard at least; links of a node (twice as many on the ground layer); beam widths of building and searching.
SHARD, LINKS, BUILD, SEARCH = 4096, 16, 80, 160
#: Queries that one copy of a shard answers.
BLOCK = 1 << 16
#: Shards that a query visits at most without routing; bytes of the vectors of a shard at most (one node at least).
EVERYWHERE, BYTES = 3, 1 << 26
#: Routing: rows of the sample that centres are fitted on (about, twice as many at most), centres at most, rounds of fitting,
#: sample rows that measure the reach of cells, and the share of their neighbours that the visited cells hold.
SAMPLE, CENTRES, ROUNDS, PROBES, REACH = 32_768, 1024, 12, 256, 0.97


class Graph:
    """HNSW over rows of ``points`` (float32, least squared distance); layers are (nodes, width) int32 arrays, -1 for none."""

    def __init__(self, points: np.ndarray, links: int = LINKS, build: int = BUILD, seed: int = 1):
        self.points, n = points, len(points)
        self.links, self.build = links, build
        rng = np.random.default_rng(seed)
        self.levels = np.minimum((-np.log(1 - rng.random(n)) / np.log(links)).astype(int), 8)
        self.layers = [np.full((n, 2 * links if i == 0 else links), -1, np.int32) for i in range(int(self.levels.max(initial=0)) + 1)]
        self.sizes = [np.zeros(n, np.int32) for _ in self.layers]
        self.norms = np.einsum("ij,ij->i", points, points)
        self.entry, self.top = 0, int(self.levels[0]) if n else 0
        self.seen = np.zeros(n, np.int32)
        self.tick = 0
        for i in range(1, n):
            self._add(i)

    def _far(self, q: np.ndarray, q2: float, at: np.ndarray) -> np.ndarray:
        return self.norms[at] + q2 - 2.0 * (self.points[at] @ q)

    def _descend(self, q: np.ndarray, q2: float, start: int, layer: int) -> int:
        best, far = start, float(self._far(q, q2, np.array([start]))[0])
        while True:
            near = self.layers[layer][best, : self.sizes[layer][best]]
            if not len(near):
                return best
            d = self._far(q, q2, near)
            i = int(d.argmin())
            if d[i] >= far:
                return best
            best, far = int(near[i]), float(d[i])

    def _beam(self, q: np.ndarray, q2: float, start: int, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest found, nearest first; several unexpanded nodes are expanded at once."""
        self.tick += 1
        seen, tick, table_, sizes = self.seen, self.tick, self.layers[layer], self.sizes[layer]
        ids = np.array([start])
        far = self._far(q, q2, ids)
        done = np.zeros(1, bool)
        seen[start] = tick
        while True:
            open_ = np.flatnonzero(~done)[:4]
            if not len(open_):
                return ids, far
            done[open_] = True
            near = table_[ids[open_]].ravel()
            near = near[near >= 0]
            near = near[seen[near] != tick]
            if not len(near):
                continue
            near = np.unique(near)
            seen[near] = tick
            d = self._far(q, q2, near)
            if len(ids) >= width:
                keep = d < far[-1]
                near, d = near[keep], d[keep]
                if not len(near):
                    continue
            ids, far, done = np.concatenate([ids, near]), np.concatenate([far, d]), np.concatenate([done, np.zeros(len(near), bool)])
            order = np.argsort(far, kind="stable")[:width]
            ids, far, done = ids[order], far[order], done[order]

    def _pick(self, ids: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
        """Neighbours in different directions: one is skipped if a chosen one is nearer to it than the node is; rest fills up."""
        if len(ids) <= most:
            return ids
        p = self.points[ids]
        own = self.norms[ids]
        apart = own[:, None] + own[None, :] - 2.0 * (p @ p.T)
        chosen: list[int] = []
        skipped: list[int] = []
        closest = np.full(len(ids), np.inf)
        for i in range(len(ids)):
            if closest[i] >= far[i]:
                chosen.append(i)
                if len(chosen) == most:
                    break
                np.minimum(closest, apart[i], out=closest)
            else:
                skipped.append(i)
        return ids[(chosen + skipped[: most - len(chosen)])[:most]]

    def _add(self, i: int) -> None:
        q, q2, level = self.points[i], self.norms[i], int(self.levels[i])
        at = self.entry
        for layer in range(self.top, level, -1):
            at = self._descend(q, q2, at, layer)
        for layer in range(min(level, self.top), -1, -1):
            ids, far = self._beam(q, q2, at, layer, self.build)
            at = int(ids[0])
            chosen = self._pick(ids, far, self.links)
            table_, sizes = self.layers[layer], self.sizes[layer]
            table_[i, : len(chosen)] = chosen
            sizes[i] = len(chosen)
            width = table_.shape[1]
            full = sizes[chosen] >= width
            free = chosen[~full]
            table_[free, sizes[free]] = i
            sizes[free] += 1
            for j in chosen[full]:
                pool = np.append(table_[j], i)
                d = self._far(self.points[j], self.norms[j], pool)
                order = np.argsort(d, kind="stable")
                table_[j] = self._pick(pool[order], d[order], width)
        if level > self.top:
            self.entry, self.top = i, level

    def search(self, q: np.ndarray, k: int, width: int = SEARCH) -> np.ndarray:
        """About the ``k`` nearest nodes, nearest first."""
        if not len(self.points):
            return np.zeros(0, np.int64)
        q2, at = float(q @ q), self.entry
        for layer in range(self.top, 0, -1):
            at = self._descend(q, q2, at, layer)
        return self._beam(q, q2, at, 0, max(width, k))[0][:k]

    def to_arrays(self) -> dict[str, bytes]:
        """Flat form: one neighbour array for all layers."""
        flat = np.concatenate([t.ravel() for t in self.layers]) if len(self.points) else np.zeros(0, np.int32)
        return {"neighbours": flat.astype(np.int32).tobytes(), "shape": np.array([len(self.points), self.points.shape[1], self.links, len(self.layers), self.entry, self.top], np.int64).tobytes()}

    @classmethod
    def from_arrays(cls, points: np.ndarray, neighbours: bytes, shape: bytes) -> Graph:
        out = cls.__new__(cls)
        n, _, links, layers, out.entry, out.top = (int(v) for v in np.frombuffer(shape, np.int64))
        flat, at = np.frombuffer(neighbours, np.int32), 0
        out.points, out.links, out.layers = points, links, []
        for i in range(layers):
            width = 2 * links if i == 0 else links
            out.layers.append(flat[at : at + n * width].reshape(n, width))
            at += n * width
        out.sizes = [(t >= 0).sum(axis=1) for t in out.layers]
        out.norms = np.einsum("ij,ij->i", points, points)
        out.seen, out.tick = np.zeros(n, np.int32), 0
        return out


def _lifted(vectors: np.ndarray, longest: float | None = None) -> np.ndarray:
    norms = np.einsum("ij,ij->i", vectors, vectors)
    top = norms.max() if longest is None else longest
    return np.hstack([vectors, np.sqrt(np.maximum(top - norms, 0))[:, None]]).astype(np.float32)


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances less the points' own squares."""
    return np.einsum("ij,ij->i", centres, centres)[None, :] - 2.0 * (points @ centres.T)


class Router:
    """Cells of one dimension: rows go to the nearest centre, queries to the ``visits`` nearest centres."""

    def __init__(self, sample: np.ndarray, longest: float, cells: int, k: int):
        self.longest = longest
        points = _lifted(sample, longest)
        self.centres = points[:: max(1, len(points) // cells)][:cells].copy()
        for _ in range(ROUNDS):
            own = self.cells(sample)
            counts = np.bincount(own, minlength=len(self.centres))
            sums = np.zeros_like(self.centres, dtype=np.float64)
            np.add.at(sums, own, points)
            self.centres[counts > 0] = (sums[counts > 0] / counts[counts > 0, None]).astype(np.float32)
        own, probes = self.cells(sample), sample[:PROBES]
        nearness = probes @ sample.T
        nearness[np.arange(len(probes)), np.arange(len(probes))] = -np.inf
        best = np.argsort(-nearness, axis=1)[:, : min(k, len(sample) - 1)]
        place = np.argsort(self._order(probes), axis=1)
        ranks = np.take_along_axis(place, own[best], axis=1).ravel()
        held = np.cumsum(np.bincount(ranks, minlength=len(self.centres))) / max(1, len(ranks))
        self.visits = int(np.searchsorted(held, REACH)) + 1

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        points = _lifted(vectors, self.longest)
        return np.concatenate([_distances(points[i : i + 4096], self.centres).argmin(axis=1) for i in range(0, len(points), 4096)]).astype(np.int32)

    def _order(self, queries: np.ndarray) -> np.ndarray:
        return np.argsort(_distances(np.hstack([queries, np.zeros((len(queries), 1))]).astype(np.float32), self.centres), axis=1, kind="stable")

    def visited(self, queries: np.ndarray) -> np.ndarray:
        return self._order(queries)[:, : self.visits].astype(np.int32)


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v) of vectors that take part; v is an array of doubles."""
    v = F.col(vector).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), v.alias("v")).where(F.coalesce(fine & (F.size("v") > 0), F.lit(False)))


def _merge_equal(keep: int):
    """Per task: equal vectors become one row (vector bytes, its least ids), so a hot vector never travels as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            lists = batch.column(1)
            flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            groups: dict[bytes, list[int]] = {}
            for i, own in enumerate(ids.tolist()):
                groups.setdefault((flat[ends[i] : ends[i + 1]] + 0.0).tobytes(), []).append(own)
            kept = [sorted(set(g))[:keep] for g in groups.values()]
            norms = [float(np.square(np.frombuffer(v)).sum()) for v in groups]
            yield pa.RecordBatch.from_arrays([pa.array(list(groups), pa.binary()), pa.array(kept, pa.list_(pa.int64())), pa.array(norms, pa.float64())], ["v", "ids", "norm"])

    return run


def merge_equal(vectors: DataFrame, keep: int) -> DataFrame:
    """v (bytes), ids, dim: equal vectors of a task as one row; a written table."""
    merged = usable(vectors).mapInArrow(_merge_equal(keep), "v binary, ids array<bigint>, norm double")
    return materialize(merged.withColumn("dim", (F.octet_length("v") / 8).cast("int")), "hnsw-vectors")


def plan_shards(merged: DataFrame, shard: int = SHARD, everywhere: int = EVERYWHERE, most: int = BYTES) -> DataFrame:
    """dim, n, longest (squared), nodes (of a shard), shards: one row a dimension."""
    per = merged.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest"))
    room = F.greatest(F.lit(1), F.floor(F.lit(most) / (F.col("dim") * 8)))
    nodes = F.least(room, F.greatest(F.lit(shard), F.ceil(F.col("n") / everywhere)))
    return per.withColumn("nodes", nodes.cast("bigint")).withColumn("shards", F.ceil(F.col("n") / F.col("nodes")))


def fit_routers(merged: DataFrame, plan: DataFrame, k: int, everywhere: int = EVERYWHERE) -> dict[int, Router]:
    """A router for each dimension with more shards than ``everywhere`` (each of them fills that many shards)."""
    out = {}
    for r in plan.where(F.col("shards") > everywhere).collect():
        part = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, SAMPLE / r["n"])))
        rows = merged.where((F.col("dim") == r["dim"]) & part).select("v").limit(2 * SAMPLE).toPandas()["v"]
        if len(rows) > 1:
            out[r["dim"]] = Router(np.array([np.frombuffer(v) for v in sorted(map(bytes, rows))]), r["longest"], min(CENTRES, r["shards"], len(rows)), k)
    return out


def _celled(merged: DataFrame, routers: dict[int, Router]) -> DataFrame:
    """With each row's cell; dimensions without a router are one cell."""
    if not routers:
        return merged.withColumn("cell", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.zeros(batch.num_rows, np.int32)
            dims = batch.column("dim").to_numpy()
            for dim, router in routers.items():
                at = np.flatnonzero(dims == dim)
                if len(at):
                    cells[at] = router.cells(np.array([np.frombuffer(batch.column("v")[int(i)].as_buffer()) for i in at]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("v", "ids", "dim")), pa.array(cells)], ["v", "ids", "dim", "cell"])

    return materialize(merged.select("v", "ids", "dim").mapInArrow(run, "v binary, ids array<bigint>, dim int, cell int"), "hnsw-cells")


def _tasks(units: int | None) -> int:
    """Partitions for so many units of work, few of which shall meet in one."""
    return min(20_000, 3 * (units or 0) + 1)


def index_shards(merged: DataFrame, plan: DataFrame, routers: dict[int, Router], keep: int) -> DataFrame:
    """One row a shard: dim, cell, shard, ids (offsets and values), vectors, and the graph's flat arrays."""
    celled = _celled(merged, routers)
    parts = celled.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("c")).join(plan.select("dim", "nodes"), "dim").select("dim", "cell", F.ceil(F.col("c") / F.col("nodes")).alias("parts"))
    dealt = celled.join(parts, ["dim", "cell"]).select("dim", "cell", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("shard"), "v", "ids")
    dealt = dealt.repartition(_tasks(plan.agg(F.sum("shards")).first()[0]), "dim", "cell", "shard")  # small, but long to build: never gathered in few tasks

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        groups: dict[bytes, set] = {}
        for v, ids in zip(rows["v"], rows["ids"]):
            groups.setdefault(bytes(v), set()).update(int(i) for i in ids)
        nodes = sorted((min(ids), v, sorted(ids)[:keep]) for v, ids in groups.items())
        points = np.array([np.frombuffer(v) for _, v, _ in nodes])
        graph = Graph(_lifted(points))
        ends = np.cumsum([0, *(len(i) for _, _, i in nodes)])
        return pd.DataFrame([{"dim": int(key[0]), "cell": int(key[1]), "shard": int(key[2]), "ends": ends.astype(np.int64).tobytes(), "ids": np.concatenate([i for _, _, i in nodes]).astype(np.int64).tobytes(), "vectors": points.tobytes(), **graph.to_arrays()}])

    return dealt.groupBy("dim", "cell", "shard").applyInPandas(run, "dim int, cell int, shard int, ends binary, ids binary, vectors binary, neighbours binary, shape binary")


def build_index(vectors: DataFrame, keep: int = 21, shard: int = SHARD) -> DataFrame:
    """The shards of all vectors, without routing (:func:`nearest` routes where the table needs it)."""
    merged = merge_equal(vectors, keep)
    return index_shards(merged, plan_shards(merged, shard), {}, keep)


def query_blocks(queries: DataFrame, block: int = BLOCK, routers: dict[int, Router] | None = None) -> DataFrame:
    """dim, cell, block, id, v (bytes) of each query for each cell it visits; a block has about ``block`` queries of one cell."""
    routers = routers or {}
    dealt = queries.select("id", F.size("v").alias("dim"), "v")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cells, packed = [], [], []
            for i, (dim, v) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))):
                vector = v.values.to_numpy()
                to = routers[dim].visited(vector[None])[0].tolist() if dim in routers else [0]
                rows += [i] * len(to)
                cells += to
                packed += [vector.tobytes()] * len(to)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(cells, pa.int32()), pa.array(packed, pa.binary())], ["id", "dim", "cell", "v"])

    dealt = dealt.mapInArrow(visit, "id bigint, dim int, cell int, v binary")
    counts = dealt.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    return dealt.join(F.broadcast(counts) if not routers else counts, ["dim", "cell"]).select("dim", "cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "v")


def search_index(index: DataFrame, blocks: DataFrame, k: int, width: int = SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query over the shards of its cells.

    Queries go to the shards: a shard is sent once for each block of its cell, and comes before the block's queries in the order of
    their task, which holds one shard and one batch of queries at a time. What is broadcast is the numbers of the shards, one row for
    64 MB of vectors.
    """
    blocks = materialize(blocks, "hnsw-blocks")
    copies = blocks.groupBy("dim", "cell").agg((F.max("block") + 1).alias("copies"))
    held = index.select("dim", "cell", "shard").join(copies, ["dim", "cell"])
    units = held.agg(F.sum("copies")).first()[0]
    unit, data = ["dim", "cell", "shard", "block"], ["ends", "ids", "vectors", "neighbours", "shape"]
    shards = index.join(copies, ["dim", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select(*unit, F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("binary").alias("v"), *data)
    asked = blocks.join(F.broadcast(held.select("dim", "cell", "shard")), ["dim", "cell"]).select(*unit, "id", "v", *[F.lit(None).cast("binary").alias(c) for c in data])
    meeting = shards.unionByName(asked).repartition(_tasks(units), *unit).sortWithinPartitions(*unit, F.asc_nulls_first("id")).select("dim", "id", "v", *data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = graph = ends = ids = None
        for batch in batches:
            out: list[tuple] = []
            for i, (dim, own, v) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))):
                if own is None:
                    ends, ids, points, neighbours, shape = (batch.column(c)[i].as_buffer() for c in range(3, 8))
                    points = np.frombuffer(points).reshape(-1, dim)
                    graph = Graph.from_arrays(_lifted(points), neighbours, shape)
                    ends, ids = np.frombuffer(ends, np.int64), np.frombuffer(ids, np.int64)
                    continue
                q = np.frombuffer(v.as_buffer())
                nodes = graph.search(np.append(q, 0.0).astype(np.float32), width, width)
                scores = np.array([float(np.dot(points[n], q)) for n in nodes])
                flat = [(s, int(j)) for n, s in zip(nodes, scores) for j in ids[ends[n] : ends[n + 1]] if j != own]
                flat.sort(key=lambda x: (-x[0], x[1]))
                out += [(own, j, s) for s, j in flat[:k]]
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    found = meeting.mapInArrow(run, "query_id bigint, vec_id bigint, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int, k: int, shard: int = SHARD, everywhere: int = EVERYWHERE, most: int = BYTES) -> DataFrame:
    merged = merge_equal(vectors, k + 1)
    plan = materialize(plan_shards(merged, shard, everywhere, most), "hnsw-plan")
    routers = fit_routers(merged, plan, k, everywhere)
    index = materialize(index_shards(merged, plan, routers, k + 1), "hnsw-index")
    queries = materialize(usable(vectors).where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")), "hnsw-queries")
    return search_index(index, query_blocks(queries, routers=routers), k)


def op5_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)
