"""Mixing sources to target weights by entropy balancing.

The mix takes every document at a rate that stays as close as possible (in relative entropy, weighed by words) to one
while the words taken from each margin value meet its target and no rate exceeds the cap. The dual is convex and has
one multiplier for each margin value: rates are exp(sum of the document's multipliers), clipped at the cap. Newton steps
on the joint dual run over a table of margin cells, distributed: gradient and Hessian products are grouped sums, and no
multiplier, cell or document goes to the driver. Rates are then rounded into whole copies, evenly over sizes, and
single documents are flipped to close what is left.

Defined results: a null source is a source of its own, last in order; null, empty and wordless texts have size 0 and
are taken 0 words; very long texts count whole; rows that are equal in all columns are mixed together and share their
copies evenly, rows that differ in any are mixed as rows of their own, so reruns over rows in any order agree; an
empty table gives an empty result; other columns pass through the mix and never clash, since the work is done on
row hashes, sources and sizes alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm._common import materialize, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2.0
#: Newton steps at most; conjugate gradient steps of a Newton step at most; closing flips.
STEPS, INNER, FLIPS = 40, 12, 4
#: Groups that a size class of a source is dealt to when copies are rounded: SALTS, or as many as leave SALTED rows of the source each.
SALTS, SALTED = 64, 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, rows, target) of rows (source, size, m): weights repeat along the sources by code point, null last; capped by water-filling.

    Works on one row a source. The level t solves sum(min(cap * size, t * weight)) = share * total: sources in order of
    cap * size / weight fill up one after the other, so running sums find it without iterating.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("m").alias("rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    fill = Window.orderBy(F.col("_full") / F.col("w"), F.col("source").asc_nulls_last())
    before, rest, whole = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    leveled = (
        ranked.withColumn("_full", F.col("source_size") * F.lit(cap))
        .withColumn("_total", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_full").over(before), F.lit(0.0))) / F.sum("w").over(rest))
        .withColumn("_open", F.when(F.col("_full") > F.col("_level") * F.col("w"), F.struct(F.row_number().over(fill).alias("p"), "_level")))
        .withColumn("_t", F.min("_open").over(whole)["_level"])  # the level at the first source that doesn't fill up
    )
    target = F.when(F.col("_t").isNull(), F.col("_full")).otherwise(F.least(F.col("_full"), F.col("_t") * F.col("w")))
    return leveled.select("source", "source_size", "rows", target.cast("double").alias("target"))


def _key(name: str) -> Column:
    """A margin value as text, null included; other margins' values never equal it."""
    return F.to_json(F.struct(F.col(name)))


def _clipped(cap: float) -> tuple[Column, Column]:
    """Words that a cell (n, eta) gives, and those that still move with eta."""
    tilt = F.exp("eta")
    return F.col("n") * F.least(tilt, F.lit(cap)), F.when(tilt < cap, F.col("n") * tilt).otherwise(0.0)


def _solve(state: DataFrame, links: DataFrame, rated: DataFrame) -> DataFrame:
    """key and step: the Hessian of the joint dual against the gradient, by conjugate gradients scaled with its diagonal.

    A product with the Hessian is two joins and two grouped sums over the cells; a few totals come to the driver.
    """
    vector = state.select("key", F.lit(0.0).alias("step"), F.col("miss").alias("r"), "diag").withColumn("z", F.col("r") / F.col("diag")).withColumn("p", F.col("z"))
    vector = materialize(vector, "mix-direction")
    rz = first = vector.agg(F.sum(F.col("r") * F.col("z"))).first()[0] or 0.0
    free = rated.select("_cell", "free")
    for _ in range(INNER):
        if rz <= 1e-16 * first:
            break
        along = links.join(vector.select("key", "p"), "key").groupBy("_cell").agg(F.sum("p").alias("q")).join(free, "_cell")
        product = links.join(along, "_cell").groupBy("key").agg(F.sum(F.col("free") * F.col("q")).alias("hp"))
        vector = materialize(vector.join(product, "key"), "mix-direction")
        curve = vector.agg(F.sum(F.col("p") * F.col("hp"))).first()[0] or 0.0
        if curve <= 0:
            vector = vector.drop("hp")
            break
        vector = vector.withColumn("step", F.col("step") + F.lit(rz / curve) * F.col("p")).withColumn("r", F.col("r") - F.lit(rz / curve) * F.col("hp")).withColumn("z", F.col("r") / F.col("diag")).drop("hp")
        now = vector.agg(F.sum(F.col("r") * F.col("z"))).first()[0] or 0.0
        vector = vector.withColumn("p", F.col("z") + F.lit(now / rz) * F.col("p"))
        rz = now
    return vector.select("key", "step")


def _alone(x: DataFrame, links: DataFrame, cap: float, steps: int, tolerance: float) -> DataFrame:
    """key and x of a single margin: its Hessian is diagonal, so every value's steps are a fold over its own row and nothing is written between."""
    words = links.groupBy("key").agg(F.sum("n").alias("n"))

    def step(at: Column, _: Column) -> Column:
        tilt = F.exp(at)
        mass, free = F.col("n") * F.least(tilt, F.lit(cap)), F.when(tilt < cap, F.col("n") * tilt).otherwise(0.0)
        miss = F.col("goal") - mass
        move = miss / F.greatest(F.when(free > 0, free).otherwise(mass), F.lit(1e-12))
        near = F.abs(miss) / F.greatest(F.col("goal"), F.lit(1.0)) < tolerance
        return F.when(near | (at == float("-inf")), at).otherwise(at + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), move)))

    return x.join(words, "key").select("key", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("x"), step).alias("x"))


def balance(cells: DataFrame, margins: dict[str, DataFrame], cap: float = CAP, steps: int = STEPS, tolerance: float = 1e-9) -> DataFrame:
    """Rates of the cells: ``cells`` has one row for each combination of margin values with its words ``n``.

    ``margins`` gives for each margin column a table (column, target); a value without a target is taken 0 words. Each
    Newton step sums words (gradient) and movable words (diagonal of the Hessian) by margin value over all cells. With
    one margin the Hessian is diagonal and the step is their ratio (:func:`_alone`); with several, its products are summed the same
    way. Steps are scaled to 1 at most, until the largest relative miss is below the tolerance.
    """
    names = list(margins)
    held = cells.withColumn("_cell", F.to_json(F.struct(*names))).withColumn("n", F.col("n").cast("double"))
    links = materialize(held.select("_cell", "n", F.explode(F.array(*map(_key, names))).alias("key")), "mix-links")
    goals = [t.select(_key(name).alias("key"), F.col("target").cast("double").alias("goal")) for name, t in margins.items()]
    goal = goals[0]
    for more in goals[1:]:
        goal = goal.unionByName(more)
    x = links.select("key").distinct().join(goal, "key", "left").select("key", F.coalesce("goal", F.lit(0.0)).alias("goal"))
    x = x.withColumn("x", F.when(F.col("goal") > 0, 0.0).otherwise(float("-inf")))
    x = materialize(x if len(names) > 1 else _alone(x, links, cap, steps, tolerance), "mix-multipliers")
    mass, free = _clipped(cap)
    for _ in range(steps if len(names) > 1 else 0):
        rated = links.join(x.select("key", "x"), "key").groupBy("_cell").agg(F.max("n").alias("n"), F.sum("x").alias("eta")).select("_cell", mass.alias("mass"), free.alias("free"))
        rated = materialize(rated, "mix-rated")
        sums = links.select("_cell", "key").join(rated, "_cell").groupBy("key").agg(F.sum("mass").alias("mass"), F.sum("free").alias("free"))
        state = x.join(sums, "key").withColumn("miss", F.when(F.col("x") > float("-inf"), F.col("goal") - F.col("mass")).otherwise(0.0))
        state = state.withColumn("diag", F.greatest(F.when(F.col("free") > 0, F.col("free")).otherwise(F.col("mass")), F.lit(1e-12)))
        state = materialize(state, "mix-state")
        if (state.agg(F.max(F.abs("miss") / F.greatest("goal", F.lit(1.0)))).first()[0] or 0.0) < tolerance:
            break
        step = _solve(state, links, rated)
        scale = 1.0 / max(1.0, step.agg(F.max(F.abs("step"))).first()[0] or 0.0)  # one scale for the whole direction
        step = step.withColumn("step", F.col("step") * F.lit(scale))
        x = state.join(step, "key").select("key", "goal", (F.col("x") + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("step")))).alias("x"))
    eta = links.join(x.select("key", "x"), "key").groupBy("_cell").agg(F.sum("x").alias("eta"))
    return held.join(eta, "_cell").withColumn("rate", F.least(F.exp("eta"), F.lit(cap))).drop("_cell", "eta")


def _spread(part: str) -> Column:
    return F.pmod(F.xxhash64("source", "band", F.lit(part)), F.lit(1 << 20)) / F.lit(float(1 << 20))


def copies(sized: DataFrame, cap: float = CAP) -> DataFrame:
    """Whole copies of rows (id, source, size, m, rows, rate, goal), together for the ``m`` equal documents of a row.

    Rows of a source are ranked inside (size class, salt) groups, so a hot source is spread over many tasks, and take a
    further copy whenever the running rate passes a whole number. What a source then lacks or has too much is closed by
    up to FLIPS flips of one document each, whose size comes nearest; flips are a small table beside the rows.
    """
    whole, part = F.floor("rate"), F.col("rate") - F.floor("rate")
    salts = F.greatest(F.lit(SALTS), F.ceil(F.col("rows") / SALTED)).cast("bigint")
    band = F.struct(F.floor(F.log2(F.col("size") + F.lit(1.0)) * 4).cast("int").alias("b"), F.pmod(F.xxhash64("id", "size"), salts).alias("s"))
    rank = F.sum("m").over(Window.partitionBy("source", "band").orderBy("size", "id").rowsBetween(Window.unboundedPreceding, 0))
    more = F.floor(rank * part + _spread("phase")) - F.floor((rank - F.col("m")) * part + _spread("phase"))
    out = materialize(sized.withColumn("band", band).withColumn("copies", (whole * F.col("m") + more).cast("bigint")).drop("band"), "mix-copies")
    lack = out.groupBy("source").agg((F.max("goal") - F.sum(F.col("copies") * F.col("size"))).alias("lack"))
    lack = materialize(lack.withColumnRenamed("source", "_s"), "mix-lack")
    flips = None
    for turn in range(FLIPS):
        able = F.when(F.col("lack") > 0, F.col("copies") + 1 <= F.col("m") * cap).otherwise(F.col("copies") >= 1)
        gap = F.abs(F.col("size") - F.abs("lack"))
        open_ = out.where("size > 0").join(lack, F.col("source").eqNullSafe(F.col("_s"))).where(able & (gap < F.abs("lack")))
        if flips is not None:
            open_ = open_.join(flips.select("id"), "id", "left_anti")
        best = open_.groupBy("_s").agg(F.min(F.struct(gap.alias("gap"), "id", "size", F.signum("lack").cast("int").alias("sign"))).alias("f"))
        best = materialize(best.select("_s", "f.id", "f.size", "f.sign"), "mix-flips")
        if not best.limit(1).count():
            break
        taken = best.select(F.col("_s").alias("_t"), (F.col("size") * F.col("sign")).alias("took"))
        lack = materialize(lack.join(taken, F.col("_s").eqNullSafe(F.col("_t")), "left").select("_s", (F.col("lack") - F.coalesce("took", F.lit(0))).alias("lack")), "mix-lack")
        flips = best if flips is None else flips.unionByName(best)
    if flips is None:
        return out
    return out.join(flips.select("id", "sign"), "id", "left").withColumn("copies", F.col("copies") + F.coalesce("sign", F.lit(0))).drop("sign")


def row_id(docs: DataFrame) -> tuple[Column, Column]:
    """A 96-bit key of a row's content, nulls told from values."""
    plain = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if isinstance(f.dataType, (T.MapType, T.VariantType)) else F.col(f"`{f.name}`") for f in docs.schema.fields]
    gaps = F.concat(*[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in docs.columns])
    return F.xxhash64(gaps, *plain), F.hash(gaps, *plain)


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, ids: tuple[Column, Column] | None = None) -> DataFrame:
    """One row for each different row of ``docs`` (doc_id, source, text, ...): k and id2 (its key, ``ids``), m (times it occurs), doc_id, source, size, source_size, target, rate, copies."""
    id_, id2 = ids or row_id(docs)
    slim = docs.select(id_.alias("k"), id2.alias("id2"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    grouped = slim.groupBy("k", "id2").agg(F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.first("size").alias("size"), F.count(F.lit(1)).alias("m"))
    sized = materialize(grouped.withColumn("id", F.xxhash64("k", "id2")), "mix-sizes")
    targets = materialize(source_targets(sized.select("source", (F.col("size") * F.col("m")).alias("size"), "m"), weights, share, cap), "mix-targets")
    cells = targets.select("source", F.col("source_size").cast("double").alias("n"))
    rates = balance(cells, {"source": targets.select("source", "target")}, cap)
    per = rates.select(F.col("source").alias("_s"), "rate").join(targets.withColumnRenamed("source", "_r"), F.col("_s").eqNullSafe(F.col("_r")))
    joined = sized.join(per.drop("_r"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumnRenamed("target", "goal")
    done = copies(joined, cap)
    return done.select("k", "id2", "m", "doc_id", "source", "size", "source_size", F.col("goal").alias("target"), "rate", "copies")


def _share(i: Column) -> Column:
    """Copies of the i-th of the m equal documents that share ``copies``."""
    return F.floor(i * F.col("copies") / F.col("m")) - F.floor((i - 1) * F.col("copies") / F.col("m"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, rate, copies, taken."""
    plan = plan_mix(docs, weights, share, cap).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m"))))
    plan = plan.withColumn("copies", _share(F.col("_i")).cast("int"))
    return plan.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents themselves, each as often as the mix takes it."""
    names = docs.columns
    inner = docs.toDF(*[f"q{i}" for i in range(len(names))])
    place = {n: f"q{i}" for i, n in enumerate(names)}
    keyed = inner.select("*", F.col(place["doc_id"]).alias("doc_id"), F.col(place["source"]).alias("source"), F.col(place["text"]).alias("text"))
    id_, id2 = row_id(inner)
    plan = plan_mix(keyed, **how, ids=(id_, id2)).where("copies >= 1").select("k", "id2", "m", "copies")
    joined = keyed.select(*inner.columns, id_.alias("k"), id2.alias("id2")).join(plan, ["k", "id2"])
    equal = joined.where("m > 1").dropDuplicates(["k", "id2"])
    return joined.where("m = 1").unionByName(equal).withColumn("_x", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(*inner.columns).toDF(*names)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
