"""What a task holds and shuffles doesn't grow with the table."""

import json
import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quire.functions import text as fx
from quire.operators import automaton, batching, history, lexicon, structure
from quire.plans import translate


def test_terms_with_borders_equal_the_rule():
    rng = random.Random(3)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    terms = list({word(rng.randint(1, 6), "ab1 -é") for _ in range(200)})
    texts = [word(rng.randint(0, 60), "ab1 -é") for _ in range(300)] + ["", *terms]
    raw = [t.encode() for t in texts]
    rows, hits = automaton.Automaton(terms).bounded(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    edge = lambda t, at: not (0 <= at < len(t)) or t[at] not in "ab1"
    stands = lambda t, w: any(t.startswith(w, i) and edge(t, i - 1) and edge(t, i + len(w)) for i in range(len(t)))
    got = list(zip(rows.tolist(), hits.tolist()))
    assert set(got) == {(i, j) for i, t in enumerate(texts) for j, w in enumerate(terms) if stands(t, w)} and len(set(got)) == len(got)


def test_texts_stay_where_they_are_when_phrases_are_found(spark):
    terms = spark.createDataFrame([(1, 0, "of the"), (1, 1, "(a)-b"), (1, 2, "of the"), (2, 3, "İ x"), (2, 4, "ſ-ΣΑΣ")], "library_id bigint, ord bigint, term string")
    texts = spark.createDataFrame([(1, 1, "Of the (A)-b"), (2, 1, "proof the, of then"), (3, 2, "i̇ x"), (4, 2, "an İ x, S-σας"), (5, 1, None), (None, 1, "of the")], "i bigint, library_id bigint, text string").withColumn("_by", F.struct("i"))
    found = lexicon._phrases(texts, terms)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted(((r._by.i or 0), r.ord, r.term) for r in found.collect())
    assert got == [(0, 0, "of the"), (0, 2, "of the"), (1, 0, "of the"), (1, 1, "(a)-b"), (1, 2, "of the"), (4, 3, "İ x"), (4, 4, "ſ-ΣΑΣ")]
    plain = terms.where("ord < 3")
    assert sorted(map(str, lexicon._phrases(texts, plain, 1).collect())) == sorted(map(str, lexicon._phrases(texts, plain).collect()))


def test_an_automaton_holds_a_part_of_a_batch():
    machine = automaton.Automaton(["aab", "ba", "cab"])
    texts = np.frombuffer(b"abcabcaabx" * 6_000_000, np.uint8)
    tracemalloc.start()
    rows, _ = machine.hits(texts, np.arange(0, len(texts) + 1, 6000))
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()
    assert len(rows) == 2 * (len(texts) // 6000)


def test_hits_at_every_byte_are_held_for_a_part_of_a_text():
    machine = automaton.Automaton(["a", "ab", "b", "ba"])
    text = np.frombuffer(b"ab" * 2_000_000, np.uint8)
    tracemalloc.start()
    rows, hits = machine.hits(text, np.array([0, 1, len(text) - 1, len(text)]))
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()
    assert list(zip(rows.tolist(), hits.tolist())) == [(0, 0), (1, 0), (1, 1), (1, 2), (1, 3), (2, 2)]


def test_a_part_of_a_batch_has_so_many_bytes():
    sizes = [0, 5, automaton.PART - 5, 1, automaton.PART + 1, 0, 0, None, *[600_000] * 3, *[1] * 2500]
    texts = pa.array([None if n is None else "x" * n for n in sizes], pa.string())
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), texts], ["i", "t"]).slice(1)
    parts = [p.column(0).to_pylist() for p in automaton.slices(batch, (1,))]
    assert [len(p) for p in parts[:6]] == [2, 1, 1, 4, 1, 1 + 999] and sum(parts, []) == list(range(1, len(sizes)))
    assert all(len(p) == 1 or len(p) <= automaton.ROWS and sum(sizes[i] or 0 for i in p) <= automaton.PART for p in parts)


def test_texts_meet_terms_in_small_batches(spark):
    key, texts = "spark.sql.execution.arrow.maxBytesPerBatch", spark.range(3).selectExpr("id", "0L as library_id", "'a' as selected", "'b' as context")
    spark.conf.unset(key)
    lexicon.match_tiered(texts, spark.createDataFrame([(0, 0, "a", None, None, None)], "library_id bigint, ord bigint, term string, translation string, field string, note string"))
    assert int(spark.conf.get(key).removesuffix("b")) <= 8 << 20


def test_chains_look_at_a_text_once_before_it_is_shuffled(spark):
    sources = ["It goes", " on,", "\u00a0(and on", "", "then", None, "so", "it ends.”", "here", "‘ends.’\u3000", "x", "\ty", "A", "z"]
    kinds = {10: "table", 13: None}
    blocks = spark.createDataFrame([(d, i, kinds.get(i, "paragraph"), s) for d in (1, 2, None) for i, s in enumerate(sources)], "doc_id int, pos int, type string, source string")
    chains = structure.merge_chains(blocks)
    plan = chains._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan[: plan.rindex("Window")] and "RLIKE" in plan and "trim(" not in plan[plan.rindex("Window") :]
    own = [(0, 3, "It goes on, (and on"), (3, 1, ""), (4, 1, "then"), (5, 1, ""), (6, 2, "so it ends.”"), (8, 2, "here ‘ends.’"), (10, 1, "x"), (11, 1, "y"), (12, 1, "A"), (13, 1, "z")]
    assert sorted((r.doc_id or 0, r.first_pos, r.n, r.source) for r in chains.collect()) == [(d, *x) for d in (0, 1, 2) for x in own]


def test_ends_of_a_text_are_told_without_a_trimmed_copy(spark):
    rng = random.Random(4)
    made = {"".join(rng.choices([*fx.BLANKS, "a", "É", "é", ".", "!", "”", "(", "'", "\u200b", "\x1c", "\x85"], k=rng.randint(0, 6))) for _ in range(3000)}
    c, trimmed = F.col("t"), fx.js_trim(F.col("t"))
    start, end = trimmed.rlike("^[\"“‘'(\\[]*[a-zà-öø-ÿ]"), trimmed.rlike(rf"[.!?]{fx.CLOSERS}\z")
    rows = spark.createDataFrame([(t,) for t in [*made, None]], "t string")
    same = fx.starts_lowercase(c).eqNullSafe(start) & fx.ends_sentence(c).eqNullSafe(end) & fx.is_incomplete(c).eqNullSafe((trimmed != "") & ~end)
    assert rows.where(~same).count() == 0


def test_requests_are_dealt_to_more_tasks_than_a_document_has_at_once(spark):
    rows = spark.range(40).selectExpr("id % 20 as doc_id", "id div 20 as batch_no", "array(named_struct('id', 'b1', 'type', 'paragraph', 'protected', 'x')) as blocks")
    asked = translate.ask(rows, lambda messages, as_json: '{"translations": {"b1": "y"}}', "zh-CN", 2)
    assert asked.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 2
    assert [(r.translation, r.requests, r.error) for r in asked.distinct().collect()] and asked.count() == 40


def joined_rows(df):
    """Rows that the largest join of a finished query made."""
    df.collect()

    def walk(node):
        name = node.nodeName()
        below = [node.executedPlan()] if "AdaptiveSparkPlan" in name else [node.plan()] if "QueryStage" in name else [node.children().apply(i) for i in range(node.children().size())]
        own = [node.metrics().get("numOutputRows").get().value()] if "Join" in name else []
        return max([*own, *map(walk, below), 0])

    return walk(df._jdf.queryExecution().executedPlan())


def test_images_of_one_name_meet_one_asset(spark):
    images = spark.range(200).selectExpr("1 as doc_id", "id", "concat('d', id % 3, '/a.png') as src").unionByName(spark.createDataFrame([(1, 900, "b.png"), (1, 901, None), (2, 902, "a.png")], "doc_id int, id bigint, src string"))
    rows = [(1, 7, "r7", "a.png"), (1, 5, "r5", "x\\a.png"), (1, 3, "r3", "d1\\a.png"), (1, 4, "r4", "d1/a.png"), (1, 1, "r1", "a.png"), (1, 9, "r9", "b.png"), (2, 1, "s1", "y/b.png"), (2, 2, None, "y/a.png")] + [(1, i, f"n{i}", "x/a.png") for i in range(10, 210)]
    assets = spark.createDataFrame(rows, "doc_id int, ord int, relative_path string, original_path string")
    found = history.match_assets(images, assets)
    assert joined_rows(found) <= images.count()
    plain = lambda x: x.replace("\\", "/")
    fit = lambda d, src: next((r for _, o, r, p in sorted(rows, key=lambda r: r[1]) if _ == d and (plain(p) == src or plain(p).endswith("/" + src.split("/")[-1]))), None)
    assert {(r.id, r.relative_path) for r in found.collect()} == {(r.id, fit(r.doc_id, r.src) if r.src else None) for r in images.collect()}


def test_equal_searches_are_looked_for_once(spark):
    empty = {c: F.lit(None).cast("string") for c in history.SEARCHED}
    h = spark.range(200).withColumns(empty | {"context": F.concat(F.lit("lib"), (F.col("id") % 2).cast("string"))})
    found = history.search_many(spark.range(50).selectExpr("id as query_id", "'LIB1 ' as query"), h)
    assert joined_rows(found) <= 50 * 100
    assert found.count() == 50 * 100 and found.where("id % 2 = 0").count() == 0


def test_blocks_to_translate_are_computed_twice_at_most(spark):
    seen = spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text

    blocks = spark.range(30).select((F.col("id") % 3).alias("doc_id"), F.col("id").cast("int").alias("pos"), F.format_string("b%04d", "id").alias("id"), F.lit("paragraph").alias("type"), F.udf(read, "string")(F.format_string("see `c` %d", "id")).alias("source"), F.lit(None).cast("string").alias("translation"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error"))
    client = lambda messages, as_json: json.dumps({"translations": {b["id"]: "Z" + b["source"] for b in json.loads(messages[1]["content"])}})
    done = translate.translate_blocks(blocks, client)
    assert sorted(r.translation for r in done.collect()) == sorted(f"Zsee `c` {i}" for i in range(30)) and seen.value <= 60


def test_texts_to_translate_move_once_and_are_kept_once(spark):
    rows = [(d, i, f"b{i:04d}", "paragraph", f"text {i}", None, "pending", None) for d in (1, 2, None) for i in range(9)]
    blocks = spark.createDataFrame(rows, "doc_id bigint, pos int, id string, type string, source string, translation string, status string, error string")
    kept = []
    client = lambda messages, as_json: json.dumps({"translations": {b["id"]: "Z" + b["source"] for b in json.loads(messages[1]["content"]) if not b["id"].endswith("3")}})
    done = translate.translate_blocks(blocks, client, store=lambda df: kept.append(df) or df)
    assert len(kept) == 1 and kept[0]._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {(r.doc_id, r.id): (r.translation, r.status, r.error) for r in done.collect()}
    assert got == {(r[0], r[2]): (None, "failed", "missing") if r[1] == 3 else ("Z" + r[4], "translated", None) for r in rows}


def test_rows_are_packed_into_the_planned_batches(spark):
    rng = random.Random(4)
    rows = [(d, i, f"b{i:04d}", "paragraph", "x" * rng.choice([0, 1, 20, 39, 40, 41, 90]), None, "pending", None) for d in (*range(5), None) for i in rng.sample(range(99), rng.choice([1, 7, 40]))]
    blocks = spark.createDataFrame(rows, "doc_id bigint, pos int, id string, type string, source string, translation string, status string, error string")
    running = []

    def client(messages, as_json):
        running.append(1)
        time.sleep(0.02)
        seen, ids = len(running), [b["id"] for b in json.loads(messages[1]["content"])]
        running.pop()
        return json.dumps({"translations": {i: f"{' '.join(ids)} of {seen}" for i in ids}})

    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, 7)
    try:
        done = translate.translate_blocks(blocks, client, max_chars=80, max_blocks=5, parallel=3).collect()
    finally:
        spark.conf.set(key, before)
    plan = batching.plan_batches(blocks.where("doc_id is not null").select("doc_id", "pos", "id", F.length("source").alias("size")), 80, 5).collect()
    own = lambda known: {(r.doc_id, tuple(r.translation.split(" of ")[0].split())) for r in done if (r.doc_id is not None) == known}
    assert own(True) == {(r.doc_id, tuple(r.block_ids)) for r in plan} and len(done) == len(rows)
    assert sum(len(ids) for _, ids in own(False)) == sum(r[0] is None for r in rows)
    assert 1 < max(int(r.translation.split(" of ")[1]) for r in done) <= 3


def test_a_document_is_cut_once(spark):
    parsed = spark.createDataFrame([(1, "# T\n\n![f](img/a.png)", [("x/img/a.png", "a1")]), (None, "![f](b.png)\n\np", [("c.png", "c1"), ("y\\b.png", "b1")])], "doc_id int, markdown string, assets array<struct<original_path:string,relative_path:string>>")
    blocks = structure.structure_documents(parsed, repaired=False)
    assert blocks._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode") == 2
    assert sorted(r.asset_path for r in blocks.where("type = 'image'").collect()) == ["a1", "b1"]
