"""The pipeline's stages against brute-force versions of what each must keep."""

import os

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from quire.llm import mixing
from quire.llm._common import materialize

from .test_operators import components, cut_by_hand, word_sets

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    names = docs.columns
    kept = materialize(pipeline.toxicity(spark, docs, SF), "t")
    assert kept.columns == names
    left = {r.doc_id for r in kept.select("doc_id").collect()}
    assert all(i in left for i, y in labels.items() if y == 0) and len(left) < docs.count()

    rows = [(r.doc_id, r.text) for r in kept.collect()]
    want = {i for i, c in components(word_sets(rows, 5)).items() if i == c}
    kept = materialize(pipeline.minhash_dedup(spark, kept, SF), "t")
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == names

    rows = [(r.doc_id, r.text.encode()) for r in kept.collect()]
    removed = {i: c[1] for (i, _), c in zip(rows, cut_by_hand([t for _, t in rows], pipeline.REPEAT_BYTES, pipeline.REPEAT_WORDS))}
    kept = materialize(pipeline.suffix_dedup(spark, kept, SF), "t")
    assert kept.columns == names
    size = {i: len(t) for i, t in rows}
    assert all(size[r.doc_id] - removed[r.doc_id] - 6 <= len(r.text.encode()) <= size[r.doc_id] - removed[r.doc_id] for r in kept.collect())

    copies = {r.doc_id: r.copies for r in mixing.mix(kept).collect()}
    mixed = materialize(pipeline.mixing(spark, kept, SF), "t")
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {i: n for i, n in copies.items() if n}
    done = pipeline.bpe(spark, mixed, SF)
    assert done.count() == mixed.count() and done.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_run_on_hard_tables(spark, hard, tmp_path):
    sf = str(tmp_path)
    hard.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    got = pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    hard.limit(0).select("doc_id", "text", "lang", "source", "n_chars").write.mode("overwrite").parquet(f"{sf}/documents.parquet")
    assert pipeline.run(spark, sf).count() == 0


def test_repeated_rows_leave_one(spark, hard):
    kept = pipeline.minhash_dedup(spark, hard, "")
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == sorted(["1", "2", "3", "4", "5", "7", "9", "None"]) and kept.columns == hard.columns


def test_repeated_passage_of_51_words_goes(spark, docs):
    passage = " ".join(f"word{i % 10}" for i in range(51))
    assert len(passage) == 305
    own = [" ".join(f"{c}{i}" for i in range(200)) for c in "ab"]
    kept = pipeline.suffix_dedup(spark, docs([f"{own[0]}\n{passage}\n{own[0]}", f"{own[1]}\t{passage}\t{own[1]}"]).drop("k"), "")
    assert all("word" not in r.text and r.n_chars == len(r.text) for r in kept.collect())


def test_repeated_passage_of_50_words_stays(spark, docs):
    passage = " ".join(f"wording{i % 10}" for i in range(50))
    texts = [f"{c} {passage} {c}" for c in "ab"]
    assert sorted(r.text for r in pipeline.suffix_dedup(spark, docs(texts), "").collect()) == texts


def test_stages_keep_columns_of_any_name(spark, docs, no_labels, tmp_path):
    no_labels.write.parquet(f"{tmp_path}/labels.parquet")
    names = ("score", "predicted", "licence", "how", "dir", "spans", "k", "id", "m", "rate", "copies", "size", "target", "_s", "_x", "c0", "q0", "component_id", "k2", "lo", "n", "wanted", "a", "rest")
    wide = docs(["one two three", "four five six", "four five six"]).drop("score", "k", "part").withColumns({n: F.lit("own") for n in names})
    for stage in (pipeline.toxicity, pipeline.minhash_dedup, pipeline.suffix_dedup, pipeline.mixing):
        got = stage(spark, wide, str(tmp_path))
        assert got.columns == wide.columns and {tuple(r[n] for n in names) for r in got.collect()} == {("own",) * len(names)}
    assert pipeline.bpe(spark, wide, str(tmp_path)).count() == 3


def test_scratch_of_stages_goes(spark, docs, no_labels, tmp_path):
    from quire.llm._common import _scratch, scratch_scope

    with scratch_scope(spark, "test"):
        gone = materialize(docs(["a"]), "inner")
        kept = materialize(gone, "outer", scoped=False)
    assert kept.count() == 1
    root = _scratch(spark).removeprefix("file://")
    assert not [d for d in os.listdir(root) if d.startswith("test-")]
