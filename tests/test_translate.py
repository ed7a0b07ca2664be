"""Whole translation runs with a deterministic client, labels and settings."""

import json
import re

import pytest
from pyspark.sql import functions as F

from quire.functions import labels
from quire.plans import translate
from quire.sources import config, writers


def client(messages, as_json):
    """Answers in capitals; refuses JSON for texts with "textonly", leaves out "skip" in company, leaks a marker for "leak"."""
    body = messages[1]["content"]
    if as_json:
        if "textonly" in body:
            raise ValueError("no JSON today")
        blocks = json.loads(body)
    else:
        parts = re.split(r"(?m)^@@(\S+)$", body)[1:]
        blocks = [{"id": i, "source": s.strip()} for i, s in zip(parts[::2], parts[1::2])]
    out = {b["id"]: ("@@x" if "leak" in b["source"] else b["source"].upper().replace("⟦code", "⟦CODE")) for b in blocks if "skip" not in b["source"] or len(blocks) == 1}
    return "```json\n" + json.dumps({"translations": out}) + "\n```" if as_json else "\n".join(f"@@{k}\n{v}\n" for k, v in out.items())


def test_rounds(spark):
    rows = [(1, 0, "b1", "paragraph", "one `x`", None, "pending", None), (1, 1, "b2", "paragraph", "skip me", None, "pending", None), (1, 2, "b3", "formula", "$$a$$", None, "validated", None), (1, 3, "b4", "heading", "done", "DONE", "translated", None), (2, 0, "b1", "paragraph", "textonly", None, "pending", None), (3, 0, "b1", "paragraph", "leak", "old", "failed", "e")]
    blocks = spark.createDataFrame(rows, "doc_id bigint, pos int, id string, type string, source string, translation string, status string, error string")
    got = {(r.doc_id, r.id): (r.status, r.translation, r.error) for r in translate.translate_blocks(blocks, client).collect()}
    assert got == {
        (1, "b1"): ("translated", "ONE `x`", None), (1, "b2"): ("translated", "SKIP ME", None), (1, "b3"): ("validated", None, None), (1, "b4"): ("translated", "DONE", None),
        (2, "b1"): ("translated", "TEXTONLY", None), (3, "b1"): ("failed", None, "protocol marker"),
    }


def test_documents_end_to_end(spark):
    spec = "doc_id bigint, markdown string, assets array<struct<original_path:string,relative_path:string>>"
    parsed = spark.createDataFrame([(1, "# T\n\nThe text ends.\n\n## References\n\nA.", []), (2, "# T\n\nwith a leak", []), (3, "", [])], spec)
    blocks, outcome = translate.run_documents(parsed, client)
    got = {r.doc_id: (r.valid, r.body) for r in outcome.collect()}
    assert got[1][0] and "THE TEXT ENDS." in got[1][1] and got[2] == (False, None) and got[3] == (True, None)
    again = translate.repair_run(blocks.where("doc_id = 1"), client)
    assert again.where("type = 'paragraph'").first().translation == "THE TEXT ENDS."
    finished = spark.createDataFrame([(1, "f")], "doc_id bigint, fingerprint string")
    sources = spark.createDataFrame([(1, "f"), (1, "g"), (2, "f")], "doc_id bigint, fingerprint string")
    assert translate.unfinished(sources, finished).count() == 2


def test_runs_go_on_from_what_is_kept(spark, tmp_path):
    spec = "doc_id bigint, markdown string, assets array<struct<original_path:string,relative_path:string>>, fingerprint string"
    frame = lambda *rows: spark.createDataFrame([(i, m, [], f) for i, m, f in rows], spec)
    first = frame((1, "# T\n\nOne ends.", "f"), (2, "# T\n\na leak", "f"))
    got = {r.doc_id: (r.valid, r.error) for r in translate.resume_documents(first, client, str(tmp_path)).collect()}
    assert got == {1: (True, None), 2: (False, "1 blocks without a translation: b0002")}
    again = translate.resume_documents(frame((1, "# T\n\nOne ends.", "f"), (2, "# T\n\nTwo ends.", "g")), client, str(tmp_path))
    assert sorted((r.doc_id, r.fingerprint, r.valid) for r in again.collect()) == [(1, "f", True), (2, "f", False), (2, "g", True)]


def test_labels(spark):
    entry = "struct<phonetic:string,translation:string,pos:string>"
    rows = spark.createDataFrame([("w", "ctx", ("f", "译", "n."), " res ", "lookup", 2), ("w", None, None, " ", None, 3)], f"s string, c string, e {entry}, r string, o string, l int")
    a, b = rows.select(labels.result_text(F.col("s"), F.col("e"), F.col("r")).alias("t"), labels.details_text(*[F.col(x) for x in "scero"]).alias("d"), labels.record_label(F.col("o"), F.col("l")).alias("n")).collect()
    assert (a.t, a.n) == ("w /f/\nn. 译\n\nres", "查词") and (b.t, b.n) == ("", "段落翻译")
    assert a.d == "上下文\nctx\n\n本地词典\nw /f/\nn. 译\n\n语境解释\n res " and b.d == "上下文\n"
    one = spark.range(1).select(labels.stage_label(F.lit("paused")).alias("s"), labels.asked_level(F.lit("translate"), F.lit(1)).alias("a"), labels.lookup_mode(F.lit("x")).alias("m"), labels.utc_millis(F.lit("1970-01-01 00:00:02")).alias("u"), labels.job_path(F.lit("r"), F.lit("a/b"), "job.json").alias("p"), labels.is_fresh(F.lit(0), F.lit(120_001), F.lit(True)).alias("f")).first()
    assert tuple(one) == ("已暂停", 2, "dictionary-context", 2000, "r/job_id=a_b/job.json", False)


def test_settings(tmp_path, spark):
    base = config.Preset("d", "http://x", "", "m", "0.2")
    assert config.model_config({}, base) == config.ModelConfig("http://x", "", "m", 0.2, 1024)
    old = config.model_config({"api_key": "k", "model": "old", "max_tokens": 5}, base, {"old": "new"})
    assert (old.api_key, old.model, old.temperature, old.max_tokens) == ("k", "new", 0.3, 5)
    prefs = config.save_preset({"active_index": 3, "presets": "[broken"}, config.Preset("p", "u", "k2", "z"))
    assert config.model_config(prefs, base).model == "z" and config.presets_of({"presets": "nope"}) == []
    assert config.first_that_works(["a", "b"], lambda u: {"b": 1}[u]) == 1
    with pytest.raises(KeyError):
        config.first_that_works(["a"], lambda u: {}[u])
    waits, tries = [], iter([None] * 6 + ["ok"])
    assert config.poll(lambda: next(tries), waits.append) == "ok" and waits == [2, 4, 8, 16, 30, 30]
    with pytest.raises(TimeoutError):
        config.poll(lambda: None, lambda s: None, deadline=10)
    writers.save_assets(spark.createDataFrame([("d/a.bin", bytearray(b"xy"))], "relative_path string, content binary"), f"file://{tmp_path}")
    assert (tmp_path / "d/a.bin").read_bytes() == b"xy"
