"""Conversation prefix trie: which conversations begin alike, how they branch and what sharing their beginnings saves.

Turns get their places, and rebuilt conversations the digests of all their prefixes, by a two-level running sum: rows
are dealt by ranges of (conversation, place), so that even one conversation of any length is spread over tasks; each
task sums up its own rows, and what came before in a conversation is one row a task. A turn's digest depends on its
place, and a prefix is the sum of its turns' digests, in four lanes of 32 bits, so prefixes need no chain of hashes. Only
digests and sizes travel, never roles and texts.

Each partition's prefixes are combined to a partial trie, a table of nodes by digest; partial tries of neighbouring
partitions are merged, again and again, adding up members, until one is left. Lists of the conversations that end at a node stay
chunks in the order of the conversations, one chunk a partition at most, and are digested one after the other, so
that no list is ever held whole. The rollup goes from the bottom up in steps that double: each node gives what it has
gathered to the ancestor 1, 2, 4, ... levels above, which sums up whole subtrees in as many rounds as the depth has bits; nodes
without a gift and without anyone left to give to are done.

Defined results: null roles and texts are empty; a turn without a number comes first, and turns of one number are
in the order of their digests (hexadecimal MD5 of the role's bytes in decimal, a colon, role and text); repeated rows are turns of their
own; rows without conv_id take no part; very long texts are digested whole, very long conversations spread over tasks;
an empty table has no nodes, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import materialize, table
from quire.operators.ordered import running

#: Fixed by op13's contract: conversations of a family, and one more than a family's first turns at most.
FAMILY, TURNS = 5, 9
#: Partial tries that are merged to one in a round.
FAN_IN = 64
_EMPTY = hashlib.sha256(b"").hexdigest()


def digested(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest of the turn, bytes of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.encode(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), "utf-8"))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.unhex(digest).alias("digest"), F.octet_length(text).cast("bigint").alias("bytes"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, digest, bytes) of the conversations with their family's first turns, and conversations (conv_id, length)."""
    # equal turns of one number can be told apart by nothing that counts; the last column only lets ranges part them
    turns = digested(conversations).withColumn("_tie", F.monotonically_increasing_id())
    placed = materialize(running(turns, "conv_id", ["turn", "digest", "_tie"], [], lambda df: materialize(df, "trie-turns")).select("conv_id", "digest", "bytes", "nth"), "trie-places")
    sizes = placed.groupBy("conv_id").agg(F.max("nth").alias("n"))
    convs = sizes.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % TURNS)
    known = sizes.select(F.col("conv_id").alias("family"), F.col("n").alias("_n"))
    convs = materialize(convs.join(known, "family", "left").select("conv_id", "family", "h", "n", F.least("h", F.coalesce("_n", F.lit(0))).alias("taken")), "trie-conversations")
    heads = placed.where((F.col("nth") < TURNS) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "family")
    borrowed = convs.where("taken > 0").select("conv_id", "family", "taken").join(heads, "family").where("nth <= taken").select("conv_id", F.col("nth").alias("depth"), "digest", "bytes")
    own = placed.join(convs.select("conv_id", "h", "taken"), "conv_id").where("nth > h").select("conv_id", (F.col("taken") + F.col("nth") - F.col("h")).alias("depth"), "digest", "bytes")
    return borrowed.unionByName(own), convs.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def _lanes() -> list[Column]:
    """The turn's digest at its depth, in four lanes of 32 bits."""
    both = (F.xxhash64("depth", "digest"), F.xxhash64(F.lit(1), F.col("depth"), F.col("digest")))
    return [lane for h in both for lane in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]


def _joined(low: Column, high: Column) -> Column:
    low, high = low.bitwiseAND(F.lit(0xFFFFFFFF)), high.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(high, 32).bitwiseOR(low)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, p1 and p2 (the prefix), q1 and q2 (the one before), bytes and part of every prefix but the empty one, whose digest is 0."""
    laned = turns.select("conv_id", "depth", "bytes", *[lane.alias(f"g{i}") for i, lane in enumerate(_lanes())], *[lane.alias(f"s{i}") for i, lane in enumerate(_lanes())])
    sums = [f"s{i}" for i in range(4)]
    summed = running(laned, "conv_id", ["depth"], sums, lambda df: materialize(df, "trie-prefixes"))
    now = [F.col(s) for s in sums]
    before = [F.col(f"s{i}") - F.col(f"g{i}") for i in range(4)]
    path = [f(*x[i : i + 2]) for x in (now, before) for i in (0, 2) for f in (_joined,)]
    return summed.select("conv_id", "depth", "bytes", "part", *[c.alias(n) for c, n in zip(path, ("p1", "p2", "q1", "q2"))])


def _combined(rows: DataFrame, members: Column, *by: str) -> DataFrame:
    same = [F.min(c).alias(c) for c in ("depth", "q1", "q2", "bytes", "conv_id")]
    return rows.groupBy("p1", "p2", *by).agg(members.alias("n_convs"), *same)


def partial_tries(paths: DataFrame) -> DataFrame:
    """One trie for each part of the prefixes, combined where its rows lie."""
    return _combined(paths, F.count(F.lit(1)), "part")


def merge_tries(tries: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One trie of many (numbered by part): ``fan_in`` neighbours become one in each round."""
    parts = (tries.agg(F.max("part")).first()[0] or 0) + 1
    while parts > fan_in:
        tries = _combined(tries.withColumn("part", F.floor(F.col("part") / fan_in)), F.sum("n_convs"), "part")
        parts = -(-parts // fan_in)
    return _combined(tries, F.sum("n_convs"))


def ends_digests(ends: DataFrame) -> DataFrame:
    """p1, p2, ends_sha256 from chunks (p1, p2, part, ids): ids ascend inside a chunk and from part to part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for p1, p2, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                listed = ",".join(map(str, ids.values.to_numpy().tolist())).encode()
                if node == (p1, p2):
                    state.update(b"," + listed)
                    continue
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = (p1, p2), hashlib.sha256(listed)
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["p1", "p2", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_pydict({"p1": [node[0]], "p2": [node[1]], "ends_sha256": [state.hexdigest()]})

    ordered = ends.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "part").select("p1", "p2", "ids")
    return ordered.mapInArrow(run, "p1 bigint, p2 bigint, ends_sha256 string")


def _chunks(rows: DataFrame) -> DataFrame:
    return rows.groupBy("p1", "p2", "part").agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))


def roll_up(nodes: DataFrame, values: list[str]) -> DataFrame:
    """``nodes`` (p1, p2, q1, q2, depth, ...) with ``values`` summed over each node's subtree, itself included."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    rest = [c for c in nodes.columns if c not in ("q1", "q2", *values)]
    state, step, done = nodes.withColumnsRenamed({"q1": "a1", "q2": "a2"}), 1, []
    while step <= deepest:
        gifts = state.where(F.col("depth") >= step).groupBy(F.col("a1").alias("p1"), F.col("a2").alias("p2")).agg(*[F.sum(v).alias(f"_{v}") for v in values])
        given = state.join(gifts, ["p1", "p2"], "left").select(*rest, "a1", "a2", F.col(f"_{values[0]}").isNotNull().alias("met"), *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values])
        given = materialize(given, "trie-rollup")
        deep = F.col("depth") >= 2 * step
        done.append(given.where(~deep & ~F.col("met")).select(*rest, *values))
        above = given.where("met").select(F.col("p1").alias("a1"), F.col("p2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        jumped = given.where(deep).join(above, ["a1", "a2"]).select(*rest, F.col("b1").alias("a1"), F.col("b2").alias("a2"), *values)
        state = materialize(jumped.unionByName(given.where(~deep & F.col("met")).select(*jumped.columns)), "trie-ancestors")
        step *= 2
    out = state.select(*rest, *values)
    for part in done:
        out = out.unionByName(part)
    return out


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` are (conv_id, turn, role, text). saved_tokens counts a node's last text once for each member but one.
    """
    turns, convs = rebuilt(conversations)
    convs = materialize(convs, "trie-lengths")
    paths = materialize(prefixes(turns), "trie-paths")
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    root = root.select(zero.alias("p1"), zero.alias("p2"), "n_convs", zero.alias("depth"), none.alias("q1"), none.alias("q2"), zero.alias("bytes"), "conv_id")
    partial = materialize(partial_tries(paths), "trie-partial")
    nodes = materialize(merge_tries(partial).select(*root.columns).unionByName(root), "trie-nodes")

    kids = nodes.where("q1 is not null").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("_kids"))
    parents = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    n_children = F.coalesce("_kids", zero)
    prepared = nodes.join(kids, ["p1", "p2"], "left").join(parents, ["q1", "q2"], "left").select(
        "p1", "p2", "q1", "q2", "conv_id", "depth", "parent_conv_id", "n_convs", n_children.alias("n_children"),
        F.when(n_children == 0, 1).otherwise(0).cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
    )
    rolled = roll_up(materialize(prepared, "trie-prepared"), ["n_leaves", "saved_tokens"])

    stops = paths.join(convs, (paths["conv_id"] == convs["conv_id"]) & (paths["depth"] == convs["length"])).select("p1", "p2", "part", paths["conv_id"])
    turnless = convs.where("length = 0").select("conv_id").repartitionByRange("conv_id").select(zero.alias("p1"), zero.alias("p2"), F.spark_partition_id().alias("part"), "conv_id")
    ends = materialize(ends_digests(_chunks(stops).unionByName(_chunks(turnless))), "trie-ends")
    met = rolled.join(ends, ["p1", "p2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
    return met.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
