"""Document operators on small rows written for the rules they must show."""

import datetime
import io
import json
import random
import threading
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions import text as fx
from quire.operators import batching, context, history, jobs, layout, lexicon, prompt, protocol, render, structure, validate
from quire.sources import readers, versions, writers
from quire.streaming import sse
from tests import structure_by_hand


def one(spark, column, **values):
    """The column over one row of the given values."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


def each(spark, make, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


# text functions
def test_trim_and_length(spark):
    assert each(spark, fx.js_trim, ["  a﻿\n", "", "\t"]) == ["a", "", ""]
    assert each(spark, fx.js_length, ["a😀", "é"]) == [3, 1]


def test_levels(spark):
    got = each(spark, fx.context_level, ["one two three", "one two three four", "A b c d. E f g.", "A b c d. E f", "  ", "What now then? Yes! No."])
    assert got == [1, 2, 3, 2, 1, 3]


def test_sentences(spark):
    got = each(spark, fx.split_sentences, ["See Fig. 2 now. It is e.g. fine! Done", "As Smith et al. say p is 0.05. Yet no. rules.\nNew  line?", "   ", "Dr. No"])
    assert got == [["See Fig. 2 now.", "It is e.g. fine!", "Done"], ["As Smith et al. say p is 0.05. Yet no. rules.", "New  line?"], [], ["Dr. No"]]


def test_candidates(spark):
    assert each(spark, fx.is_lookup_candidate, [" don't ", "well-known", "two words", "x1", "é", "a-b-c"]) == [True, True, False, False, False, True]


def test_line_classes(spark):
    assert each(spark, fx.is_markdown_table, ["| a |\n|---|\n| 1 |", "a | b\n--- | ---", "a\nb", "| a |"]) == [True, True, False, False]
    assert each(spark, fx.is_formula, ["$$x\ny$$", "$$$$", "\\[a\\]", "x"]) == [True, False, True, False]
    assert each(spark, fx.is_caption_line, ["Fig. 3: x", "figure 2. y", "Table x", "TABLE 1 a"]) == [True, True, False, True]
    assert each(spark, fx.is_dropped_line, ["Downloaded from x", "ALL RIGHTS RESERVED", "not all rights reserved"]) == [True, True, False]
    assert each(spark, fx.is_author_line, ["Anna Bell, Carl Doe", "Dept of x, University of Y", "this is plain text", "Anna Bell."]) == [True, True, False, False]
    assert each(spark, fx.starts_lowercase, ["and so", "(and", "And", "élan"]) == [True, True, False, True]
    assert each(spark, fx.is_incomplete, ["a,", "b.", "c.”)", " ", "d (Smith, 2019)"]) == [True, False, False, False, True]


def test_protocol_tests(spark):
    assert each(spark, fx.leaks_protocol, ["x\n@@b1\ny", "[TYPE=heading]", "the TYPE is", "**TYPE: x**\nz", "a @@b"]) == [True, True, False, True, False]
    zh = lambda c: fx.has_untranslated_connector(c, F.lit("zh-CN"))
    assert each(spark, zh, ["Although Smith (2019)", "好。While van Dam et al. (2001a)", "x while Smith (2019)", "though authors (1999)"]) == [True, True, False, True]
    assert one(spark, fx.has_untranslated_connector(F.col("v"), F.lit("en-GB")), v="Although Smith (2019)") is False
    assert [one(spark, fx.is_retryable(F.col("v")), v=v) for v in (408, 404, 500)] == [True, False, True]


def test_sanitize_redact_and_names(spark):
    assert each(spark, fx.sanitize, ["[TYPE=paragraph] x", "TYPE: heading\n\ny", "【type：title】**TYPE=quote**\nz ", "TYPE of x"]) == ["x", "y", "z", "TYPE of x"]
    assert each(spark, fx.redact, ["k sk-abcdefgh12 e", "task-abcdefgh12", "eyJ" + "a" * 20 + "." + "b" * 20 + "." + "c" * 20]) == ["k <redacted-api-key> e", "task-abcdefgh12", "<redacted-token>"]
    assert each(spark, fx.safe_filename, ["a/b:  c\t", "  "]) == ["a_b_ c_（双语）.html", "paper（双语）.html"]


def test_html_and_markdown(spark):
    assert each(spark, fx.escape_html, ["<a href=\"x\">&'"]) == ["&lt;a href=&quot;x&quot;&gt;&amp;&#39;"]
    assert each(spark, fx.inline_markdown, ["**b** *i* `c` x$^{2}$ y$_{3}$ __u__\nz ***"]) == ["<strong>b</strong> <em>i</em> <code>c</code> x<sup>2</sup> y<sub>3</sub> <strong>u</strong><br>z ***"]
    assert one(spark, render.markdown_table(F.col("v")), v="| a | b |\n|---|---|\n| x\\|y | <z> |") == '<div class="table-wrap"><table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>x|y</td><td>&lt;z&gt;</td></tr></tbody></table></div>'
    assert one(spark, render.markdown_table(F.col("v")), v="one") == '<pre class="table-fallback">one</pre>'
    assert render.keep_table('<table class=x><tr><td colspan="2" onclick=e>a<script>b</script></td></tr></table>') == '<div class="table-wrap"><table><tr><td colspan="2">ab</td></tr></table></div>'


# batches
def plan(spark, sizes, chars, blocks):
    rows = spark.createDataFrame([(1, i, f"b{i}", n) for i, n in enumerate(sizes)], "doc_id bigint, pos int, id string, size int")
    return [(r.id, r.block_ids, r.char_count) for r in batching.plan_batches(rows, chars, blocks).orderBy("batch_no").collect()]


def test_batches(spark):
    assert plan(spark, [5, 5, 1, 50, 2], 10, 3) == [("batch-001", ["b0", "b1"], 10), ("batch-002", ["b2"], 1), ("batch-003", ["b3"], 50), ("batch-004", ["b4"], 2)]
    assert [len(b) for _, b, _ in plan(spark, [1] * 7, 100, 3)] == [3, 3, 1]


# context
def test_selection_contexts(spark):
    ps = ["First one here. Second is here too.", "The middle part stands alone. It ends.", "Last."]
    rows = spark.createDataFrame([("MIDDLE", ps), ("middle part stands alone", ps), ("stands alone. It ends. More?", ps), ("absent words are not here", ps)], "selected string, paragraphs array<string>")
    got = [(r.level, r.paragraph_index, r.context) for r in context.resolve_context(rows).collect()]
    assert got[0] == (1, None, "The middle part stands alone.")
    assert got[1] == (2, 1, "The middle part stands alone.")
    assert got[2] == (3, -1, "") and got[3] == (2, -1, "")


def test_pages_are_stitched(spark):
    pages = [(1, 1, ["Intro.", "It goes"]), (1, 2, ["on here", "and then"]), (1, 3, ["It stops."]), (1, 5, ["lone start", "Z."]), (2, 1, [])]
    got = {(r.doc_id, r.page): r.paragraphs for r in context.stitch_pages(spark.createDataFrame(pages, "doc_id bigint, page int, paragraphs array<string>")).collect()}
    assert got == {(1, 1): ["Intro.", "It goes on here"], (1, 2): ["It goes on here", "and then It stops."], (1, 3): ["It stops."], (1, 5): ["lone start", "Z."], (2, 1): []}


# lexicon
GLOSSARY = "library_id bigint, ord bigint, term string, translation string, field string, note string"


def test_tiered_match(spark):
    g = spark.createDataFrame([(1, 0, "Beta", "b", None, None), (1, 1, "alpha", "a", "f", None), (1, 2, "", "e", None, None), (2, 0, "gamma", "c", None, None)], GLOSSARY)
    texts = spark.createDataFrame([(1, "an ALPHA ray", "beta and gamma"), (3, "alpha", "x")], "library_id bigint, selected string, context string")
    got = {r.library_id: [e.term for e in r.terms] for r in lexicon.match_tiered(texts, g).collect()}
    assert got == {1: ["alpha", "", "Beta"], 3: []}
    assert [len(r.terms) for r in lexicon.match_tiered(texts, g, 1).orderBy("library_id").collect()] == [1, 0]


def test_bounded_match(spark):
    g = spark.createDataFrame([(1, 0, "cell", "x", None, None), (1, 1, "C++", "y", None, None), (1, 2, " ", "z", None, None)], GLOSSARY)
    texts = spark.createDataFrame([(1, "Cells in C++."), (1, "a CELL-line")], "library_id bigint, text string")
    assert [r.terms for r in lexicon.match_bounded(texts, g).orderBy("text").collect()] == [["C++"], ["cell"]]


def test_merging_and_csv(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "A", "1", None, None), (1, 1, "b", "2", None, "n"), (1, 2, "a", "3", None, None)], GLOSSARY)
    assert [(r.ord, r.term, r.translation) for r in lexicon.merge_glossary(rows).orderBy("ord").collect()] == [(0, "a", "3"), (1, "b", "2")]
    assert [(r.ord, r.term, r.translation) for r in lexicon.merge_first(rows).orderBy("ord").collect()] == [(0, "A", "1"), (1, "b", "2")]
    assert lexicon.upsert_glossary(rows).count() == 3
    csv = lexicon.to_csv(rows.withColumn("translation", F.when(F.col("ord") == 0, "x,y").otherwise(F.col("translation")))).first().csv
    assert csv == 'term,translation,field,note\nA,"x,y",,\nb,2,,n\na,3,,'
    back = lexicon.from_csv(spark.createDataFrame([(1, csv)], "library_id bigint, csv string"))
    assert [(r.term, r.translation, r.field) for r in back.orderBy("ord").collect()] == [("A", "x", 'y'), ("b", "2", None), ("a", "3", None)]
    strict = lexicon.from_csv(spark.createDataFrame([(1, csv)], "library_id bigint, csv string"), strict=True)
    assert [r.translation for r in strict.orderBy("ord").collect()] == ["x,y", "2", "3"]
    (tmp_path / "g.tsv").write_text("﻿EN\tZH\nterm\t译\tnote\r\n\n only\n x\ty\t\n", encoding="utf-8")
    assert [(r.term, r.translation, r.note) for r in readers.read_glossary_tsv(spark, str(tmp_path / "g.tsv")).orderBy("ord").collect()] == [("term", "译", "note"), ("x", "y", None)]


def test_dictionary(spark, tmp_path):
    lines = ["word,phonetic,definition,translation,pos,collins,oxford,tag,bnc,frq,exchange,detail,audio", 'Apple,ap,"a, b","fruit, red",n,0,0,,12x,0,,,', "apple,ap2,d,later,n,1,0,,0,0,,,", "two words,,,t,,1,,,,,,,", "1st,,,t,,1,,,,,,,", "rare,,,t,,0,0,,0,0,,,", "none,,,,,1,,,,,,,"]
    (tmp_path / "d.csv").write_text("\n".join(lines) + "\n")
    full = readers.read_dictionary_csv(spark, str(tmp_path / "d.csv"))
    assert {(r.word, r.translation) for r in full.collect()} == {("apple", "later"), ("rare", "t")}
    light = readers.read_dictionary_csv(spark, str(tmp_path / "d.csv"), "light")
    assert {r.word for r in light.collect()} == {"apple"}
    saved = writers.save_dictionary(light, str(tmp_path / "out"))
    assert lexicon.dictionary_status(saved).first().status == "light" and lexicon.dictionary_status(saved.limit(0)).first().status == "none"
    words = spark.createDataFrame([("APPLE",), ("two words",), ("constructor",)], "word string")
    assert {(r.word, r.translation) for r in lexicon.look_up(words, saved).collect()} == {("APPLE", "later"), ("two words", None), ("constructor", None)}
    assert readers.read_dictionary(spark, [str(tmp_path / "missing"), str(tmp_path / "out")]).count() == 1 and readers.read_dictionary(spark, ["/no/where"]).count() == 0


# layout
def test_layout(spark):
    rows = [(1, 1, 0, "Hel", 10.0, 100.0, 5.0, 10.0), (1, 1, 1, "lo", 20.0, 101.0, 5.0, 10.0), (1, 1, 2, "next", 10.0, 88.0, 5.0, 10.0), (1, 1, 3, "far", 10.0, 40.0, 5.0, 10.0), (1, 2, 0, "L1", 10.0, 50.0, 1.0, 10.0), (1, 2, 1, "L2", 10.0, 40.0, 1.0, 10.0), (1, 2, 2, "R1", 300.0, 50.0, 1.0, 10.0), (1, 2, 3, "R2", 300.0, 40.0, 1.0, 10.0), (1, 3, 0, "z", 1.0, 5.0, 1.0, 0.0), (1, 3, 1, "y", 2.0, 5.0, 1.0, 0.0)]
    items = spark.createDataFrame(rows, readers.ITEMS)
    assert {(r.page, r.columns) for r in layout.detect_columns(items).collect()} == {(1, 1), (2, 2), (3, 1)}
    assert {r.page: r.paragraphs for r in layout.page_text(items).collect()} == {1: ["Hello next", "far"], 2: ["L1 L2", "R1 R2"], 3: ["z y"]}
    assert readers.text_items(items.withColumn("x", F.lit(None).cast("double")).withColumn("str", F.when(F.col("ord") > 0, F.col("str")).otherwise(" "))).where("x = 0").count() == 7


# structure
MARKDOWN = """# A Paper

Anna Bell, Carl Doe

## Intro

First part of a sentence that

goes on here.

![alt](<img/p.png>) Figure text

Fig. 2: caption

> quoted
> text

$$x$$

| a | b |
|---|---|
| 1 | 2 |

### Sub

Downloaded from x

## References

Smith, A. One.
Jones, B. Two.
"""


def test_structure(spark):
    parsed = spark.createDataFrame([(1, MARKDOWN, [("x/img/p.png", "assets/1.png")])], "doc_id bigint, markdown string, assets array<struct<original_path:string,relative_path:string>>")
    got = structure.structure_documents(parsed).orderBy("pos").collect()
    assert [r.type for r in got] == ["title", "author", "heading", "paragraph", "image", "caption", "caption", "quote", "formula", "table", "subheading", "drop", "heading", "reference", "reference"]
    assert got[3].source == "First part of a sentence that goes on here." and got[4].asset_path == "assets/1.png" and got[7].source == "quoted\ntext"
    assert [r.id for r in got] == [f"b{i:04d}" for i in range(1, 16)] and got[14].source == "Jones, B. Two."


def test_fences(spark):
    closed, open_ = list(structure_by_hand.segments("a\n```\nx\n\ny\n```\nb")), list(structure_by_hand.segments("```\nx"))
    assert [(s.text, s.open_fence) for s in closed] == [("a", False), ("```\nx\n\ny\n```", False), ("b", False)]  # a closed fence is plain text
    assert open_[0].open_fence and structure_by_hand.classify(iter(open_))[0]["type"] == "formula"
    assert [s.text for s in structure_by_hand.segments("<table>\n\n</table>\nx")] == ["<table>\n\n</table>", "x"]


def block(i, kind, source, translation=None):
    return {"id": f"b{i}", "type": kind, "source": source, "translation": translation, "status": "translated"}


def test_repair_over_floats_and_native_finder(spark):
    blocks = [block(1, "paragraph", "It starts, then"), block(2, "table", "| a |"), block(3, "caption", "Table 1"), block(4, "paragraph", "ends late and"), block(5, "paragraph", "again."), block(6, "paragraph", "Open end"), block(7, "heading", "H"), block(8, "paragraph", "lower")]
    rest, into, gone = structure.repair(blocks)
    assert [b["source"] for b in rest] == ["It starts, then ends late and", "| a |", "Table 1", "again.", "Open end", "H", "lower"] or [b["source"] for b in rest][0] == "It starts, then ends late and again."
    assert structure.repair(rest)[1] == []  # idempotent
    rows = spark.createDataFrame([(1, i, b["id"], b["type"], b["source"]) for i, b in enumerate(blocks)], "doc_id bigint, pos int, id string, type string, source string")
    want = {(b["id"], blocks[to]["id"]) for i, b in enumerate(blocks) if (to := structure.continuation_of(blocks, i)) is not None}
    assert {(r.id, r.next_id) for r in structure.continuation_pairs(rows).collect()} == want
    fixed = structure.repair_documents(rows.withColumn("translation", F.lit("t")).withColumn("status", F.lit("s")), reset=True).orderBy("pos").collect()
    assert fixed[0].translation is None and fixed[0].status == "pending" and fixed[1].translation == "t"


# protocol
def test_protect_and_restore(spark):
    source = "See `x` and <b>y</b>, $a$ at https://e.org/q) or 10.1000/ab.1; as Smith et al. (2019) say (Jones, 2001, p. 3)."
    first = protocol.protect_texts(spark.createDataFrame([(source,)], "source string")).first()
    assert [s.token.strip("⟦⟧").split("_")[0] for s in first.spans] == ["CODE", "CODE", "CODE", "MATH", "URL", "DOI", "CIT", "CIT"]
    rows = protocol.protect_texts(spark.createDataFrame([(1, f" {source} "), (2, "see (https://x.org 2019)"), (3, None)], "id int, source string"))
    got = {r.id: (r.r.text, r.r.lost) for r in rows.withColumn("r", protocol.restore(F.col("protected"), F.col("spans"))).collect()}
    assert got[1] == (source, None) and got[2] == (None, "⟦URL_0⟧") and got[3] == ("", None)  # a span in a span is lost unless asked for
    again = rows.withColumn("r", protocol.restore(F.col("protected"), F.col("spans"), nested=True))
    assert again.where("id = 2").first().r.text == "see (https://x.org 2019)"
    lost = rows.where("id = 1").withColumn("r", protocol.restore(F.lit("nothing"), F.col("spans"))).first().r
    assert (lost.text, lost.lost) == (None, "⟦CODE_0⟧")


def test_answers(spark):
    out = spark.createDataFrame([("r", "Sure!\r\n@@b1\none\n\ntwo\n @@b2 \n\n@@b1\nlast\n"), ("s", "no ids")], "request_id string, output string")
    assert [(r.request_id, r.id, r.translation) for r in protocol.parse_ids(out).collect()] == [("r", "b1", "last")]
    out = spark.createDataFrame([("r", '```json\n{"translations": {"b1": " x ", "b2": 5, "b3": " "}}\n```'), ("s", "[1]"), ("t", "{bad")], "request_id string, output string")
    assert {(r.request_id, r.id, r.translation, r.failed) for r in protocol.parse_json(out).collect()} == {("r", "b1", "x", False), ("s", None, None, True), ("t", None, None, True)}
    terms = one(spark, protocol.parse_terms(F.col("v")), v='{"terms": [{"en": " a ", "zh": "甲"}, {"en": "", "zh": "x"}, {"en": "b"}]}')
    assert [(t.term, t.translation) for t in terms] == [("a", "甲")]


def test_acceptance(spark):
    rows = protocol.protect_texts(spark.createDataFrame([(1, "b1", "a `x`"), (1, "b2", "b"), (1, "b3", "c `y`")], "doc_id bigint, id string, source string"))
    answers = spark.createDataFrame([(1, "b1", "[TYPE=paragraph] 甲 ⟦CODE_0⟧"), (1, "b3", "丙")], "doc_id bigint, id string, translation string")
    assert {(r.id, r.status, r.translation, r.error) for r in protocol.accept(rows, answers).collect()} == {("b1", "translated", "甲 `x`", None), ("b2", "failed", None, "missing"), ("b3", "failed", None, "lost ⟦CODE_0⟧")}


# validation, rendering, prompts
def test_validation(spark):
    cols = "doc_id bigint, pos int, id string, type string, source string, translation string, asset_path string"
    rows = [(1, 0, "b1", "paragraph", "Open,", "x ⟦URL_1⟧", None), (1, 1, "b1", "paragraph", "low.", "Although Smith (2019) x", None), (1, 2, "b3", "image", "", None, None), (1, 3, "b4", "heading", " ", "@@b9", None), (2, 0, "b1", "title", "T", "t", None)]
    found = validate.issues(spark.createDataFrame(rows, cols))
    assert [(r.block_id, r.code) for r in found.orderBy("ord").collect()] == [("b1", "unresolved-placeholder"), ("b1", "duplicate-id"), ("b1", "untranslated-connector"), ("b3", "missing-asset"), ("b4", "missing-source"), ("b4", "protocol-leak"), ("b1", "structure-boundary"), ("b1", "structure-boundary")][: found.count()]
    rolled = {r.doc_id: (r.valid, r.error) for r in validate.rollup(spark.createDataFrame([(1,), (2,)], "doc_id bigint"), found).collect()}
    assert rolled[2] == (True, None) and rolled[1][0] is False and rolled[1][1].startswith("Block b1 contains an unresolved")


def test_rendering(spark):
    cols = "doc_id bigint, pos int, id string, type string, source string, translation string, asset_path string, source_asset_path string"
    rows = [(1, 0, "b1", "title", "T & t", "[TYPE=title] 题", None, None), (1, 1, "b2", "drop", "x", None, None, None), (1, 2, "b3", "image", "pic", None, "a.png", "i/a.png"), (1, 3, "b4", "image", "", None, None, "i/b.png"), (1, 4, "b5", "table", "<table><tr><td>1</td></tr></table>", "| a |\n|---|", None, None)]
    assets = spark.createDataFrame([("a.png", bytearray(b"\x01\x02"))], "asset_path string, content binary")
    body = render.render_bodies(spark.createDataFrame(rows, cols), assets).first().body.split("\n")
    assert body[0] == '<h1 class="bilingual-block" data-block-id="b1"><span class="en">T &amp; t</span><span class="zh">题</span></h1>'
    assert body[1].startswith('<figure><img src="data:image/png;base64,AQI=" alt="pic"') and "图片资源缺失：i/b.png" in body[2] and "<td>1</td>" in body[3] and "<th>a</th>" in body[3]
    assert one(spark, render.fill_template(F.lit("<t>{{TITLE}}</t>{{META}}{{BODY}}"), F.lit("a<b"), F.lit("m"), F.lit("$$x$$"))) == "<t>a&lt;b</t>m$$x$$"


def test_prompts(spark):
    terms = "array<struct<term:string,translation:string,field:string,note:string>>"
    rows = spark.createDataFrame([(1, "w", "c", "zh-CN", True, [("a", "甲", "f", "n")]), (3, "w", "c", "zh-CN", False, [])], f"level int, selected string, context string, target_language string, has_dict boolean, terms {terms}")
    a, b = (r.messages for r in prompt.selection_prompt(rows).orderBy("level").collect())
    assert prompt.WITH_ENTRY in a[0].content and "a → 甲 (f)" in a[1].content and "术语" not in b[1].content and "段落" in b[1].content
    assert [r.x for r in rows.orderBy("level").select(prompt.paper_glossary(F.col("terms")).alias("x")).collect()] == ["a → 甲（n）", "（无）"]


# jobs and history
def test_progress(spark):
    rows = spark.createDataFrame([("completed", None, 0, 0), ("paused", "translating", 1, 2), ("queued", None, 0, 0), ("attaching", None, 9, 3)], "stage string, last string, done int, total int")
    got = [r.x for r in rows.select(jobs.progress_percent(F.col("stage"), F.col("last"), F.col("done"), F.col("total")).alias("x")).collect()]
    assert got == [100.0, 43.75, 0.0, 87.5]


def test_job_manager():
    log, seen = [], []
    stages = {s: (lambda state, s=s: log.append(s) or state) for s in jobs.STAGES[:-1]}
    m = jobs.JobManager(stages)
    with pytest.raises(PermissionError):
        m.start("j", "f")
    m.consented = True
    m.subscribe(seen.append)
    m.subscribe(lambda j: 1 / 0)
    assert m.start("j", "f")["stage"] == "completed" and log == list(jobs.STAGES[:-1]) and seen[-1]["stage"] == "completed"
    m.start("j", "f")
    assert len(log) == 7  # a finished job is reused
    m.rerender("j")
    assert log[7:] == ["validating", "rendering", "attaching"]
    m.stages = stages | {"translating": lambda s: (_ for _ in ()).throw(ValueError("key sk-abcdefgh99"))}
    assert m.start("k", "f")["stage"] == "failed" and "sk-" not in m.jobs["k"]["error"]
    m.stages = stages
    assert m.resume("k")["stage"] == "completed" and m.jobs["k"]["attempt"] == 2
    m.start("k", "new print")
    m.pause("k")
    m.jobs["k"]["done"] = []
    assert m.resume("k")["stage"] == "paused"


def test_jobs_outlive_their_manager(tmp_path):
    stages = {s: (lambda state, s=s: state | {s: state.get(s, 0) + 1}) for s in jobs.STAGES[:-1]}
    make = lambda **more: jobs.JobManager(stages, consented=True, store=jobs.JobStore(f"file://{tmp_path}"), **more)
    m = make()
    assert m.start("a", "f", "att")["stage"] == "completed"
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "job.json").write_text("{no")
    again = make()
    assert again.start("b", "f", "att")["id"] == "a" and list(again.jobs) == ["a"]  # the output exists: the same job
    gone = make(output_exists=lambda job: False)
    assert gone.start("b", "f", "att")["state"] == {s: 1 + (s in ("validating", "rendering", "attaching")) for s in jobs.STAGES[:-1]}
    assert gone.start("b", "other", "att")["id"] == "b" and len(gone.jobs) == 2
    gone.cancel("b")
    assert make().start("c", "other", "att")["id"] == "c"  # a cancelled job isn't reused
    refused = make(refusal=lambda job: "no key")
    with pytest.raises(PermissionError, match="no key"):
        refused.resume("a")
    held = make()
    held._move(held.jobs["a"], "translating")
    assert make().jobs["a"]["stage"] == "paused" and make().jobs["a"]["last_active_stage"] == "translating"
    held.store.save = lambda job: (_ for _ in ()).throw(OSError("disk full eyJ" + "a" * 20 + "." + "b" * 20 + "." + "c" * 20))
    assert held.resume("a")["stage"] == "completed" and ("save", "disk full <redacted-token>") in held.jobs["a"]["events"]


def test_pause_ends_the_running_stage(spark):
    def slow(state):
        began.set()
        return {"n": spark.range(0, 1 << 40, 1, 4).selectExpr("sum(id % 7)").collect()}

    began = threading.Event()
    m = jobs.JobManager({"translating": slow, "rendering": lambda s: s}, consented=True, spark=spark)
    run = threading.Thread(target=m.start, args=("j", "f"))
    run.start()
    assert began.wait(30)
    time.sleep(1)
    assert m.start("j", "f")["attempt"] == 1  # a job runs once at a time
    m.pause("j")
    run.join(30)
    assert not run.is_alive() and m.jobs["j"]["stage"] == "paused" and m.jobs["j"]["last_active_stage"] == "translating"


def test_aborted_waits_and_truncated_answers(spark):
    stop = threading.Event()
    stop.set()
    with pytest.raises(jobs.Aborted):
        jobs.with_retry(lambda: 1 / 0, jobs.abortable_sleep(stop))
    answers = iter([{"content": "half", "finish": "length"}, {"content": "whole"}])
    assert jobs.with_retry(lambda: readers_once(next(answers)), lambda s: None)["content"] == "whole"
    rows = spark.createDataFrame([("r1", [("user", "hi")]), ("r2", [("user", "cut")])], "request_id string, messages array<struct<role:string,content:string>>")
    got = {r.request_id: (r.content, r.error) for r in readers.complete(rows, lambda m: {"content": "ok", "finish": "length" if m[0]["content"] == "cut" else "stop"}, sleep=lambda s: None).collect()}
    assert got == {"r1": ("ok", None), "r2": (None, "the answer was cut off")}


def readers_once(answer):
    if answer.get("finish") == "length":
        raise jobs.Truncated
    return answer


def test_replacement_is_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda v: spark.createDataFrame([(v,)], "id string")
    writers.put_json(frame("one"), path)
    writers.put_json(spark.read.json(path).selectExpr("concat(id, ' two') as id"), path)  # what is replaced may be what is read
    assert spark.read.json(path).first().id == "one two"
    (tmp_path / "t").rename(tmp_path / "t.old")  # a crash between the two renames
    assert readers.read_jobs(spark, path, lines=True).first().id == "one two"


def test_debounced_refresh():
    seen = []
    refresh = sse.Debouncer(seen.append, 0.05)
    for i in range(5):
        refresh(i)
    time.sleep(0.3)
    assert seen == [4]


def test_throttle_stream_equals_its_batch_twin(spark, tmp_path):
    rows = [(j, o, at) for j in (1, 2) for o, at in enumerate((0, 400, 1000, 1999, 2000, 5000, 5100))]
    batch = sorted((r.job_id, r.ord) for r in jobs.throttled(spark.createDataFrame(rows, "job_id bigint, ord bigint, at_ms bigint")).collect())
    assert batch == [(j, o) for j in (1, 2) for o in (0, 2, 4, 5)]
    for part in ([r for r in rows if r[1] < 4], [r for r in rows if r[1] >= 4]):
        spark.createDataFrame(part, "job_id bigint, ord bigint, at_ms bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken by age
    stream = spark.readStream.schema("job_id bigint, ord bigint, at_ms bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sse.throttle_stream(stream).writeStream.format("memory").queryName("throttled").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.job_id, r.ord) for r in spark.table("throttled").collect()) == batch


def test_retry():
    calls, waits = [], []

    class Busy(Exception):
        status = 429

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise Busy
        return "ok"

    assert jobs.with_retry(call, waits.append) == "ok" and waits == [1.0, 2.0]
    Busy.status = 404
    calls.clear()
    with pytest.raises(Busy):
        jobs.with_retry(call, waits.append)


def test_history(spark):
    cols = "library_id bigint, id string, ord bigint, selected string, context string, result string, item_title string, library_name string, operation string, phonetic string, translation string, ts_ms bigint"
    rows = [(1, f"i{i}", i, f"Sel {i}", None, "Result", None, "lib", "lookup", None, "译", i) for i in range(5)]
    h = spark.createDataFrame(rows, cols)
    assert history.search(h, " sel 3 ").count() == 1 and history.search(h, "  ").count() == 5 and history.search(h, "zz").count() == 0 and history.search(h, "译").count() == 5
    assert [r.id for r in history.newest(h, 2).orderBy("rank").collect()] == ["i4", "i3"]
    assert history.delete(h, h.where("ord = 1")).count() == 4 and [r.ord for r in history.by_time(h).collect()] == [4, 3, 2, 1, 0]
    w = spark.createDataFrame([(1, 1, "a", 5, 1, "x"), (1, 1, "a", 0, 2, None), (1, 1, "b", 7, 3, "y")], "item_id int, page int, action string, ts_ms bigint, ord bigint, llm_result string")
    assert [(r.action, r.llm_result) for r in history.cache_latest(w, ["item_id", "page", "action"]).collect()] == [("b", "y")]


# sources and sinks
def test_json_scans(spark, tmp_path):
    assert readers.read_glossary(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "g.json").write_text(json.dumps({"library_id": 3, "entries": [{"term": "a", "translation": "甲"}]}))
    assert readers.read_glossary(spark, str(tmp_path / "g.json")).first().term == "a"
    (tmp_path / "jobs").mkdir()
    (tmp_path / "jobs" / "a.json").write_text(json.dumps({"id": "a", "stage": "completed", "updated_ms": 1}))
    (tmp_path / "jobs" / "b.json").write_text(json.dumps({"id": "b", "stage": "failed", "updated_ms": 2}))
    (tmp_path / "jobs" / "c.json").write_text("{broken")
    assert [r.id for r in readers.read_jobs(spark, str(tmp_path / "jobs")).collect()] == ["b", "a"]
    writers.save_stamped(spark.createDataFrame([("z",)], "id string"), str(tmp_path / "out"), 7)
    assert readers.read_job(spark, str(tmp_path / "out"), "z").first().updated_ms == 7
    writers.save_html(spark.createDataFrame([("n", "<p>\nx")], "name string, html string"), str(tmp_path / "html"))
    assert spark.read.text(str(tmp_path / "html"), wholetext=True).first().value == "<p>\nx\n"
    assert writers.save_preferences({"concurrency": 9, "batch_chars": 1, "output_tokens": 5000}) == {"concurrency": 4, "batch_chars": 4000, "output_tokens": 5000}


def test_archives_and_fulltext(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, data in (("a.md", "short"), ("d/full.md", "longer text"), ("img/p 1.PNG", "x"), ("n.txt", "n")):
            z.writestr(name, data)
    got = readers.unpack_archives(spark.createDataFrame([(1, bytearray(buffer.getvalue()))], "doc_id bigint, content binary")).first()
    assert got.markdown == "longer text" and [(a.original_path, a.relative_path) for a in got.assets] == [("img/p 1.PNG", "assets/0001-p_1.PNG")]
    full = readers.parse_fulltext(spark.createDataFrame([(1, "the Title here. x", "The title"), (2, "body", "Other")], "doc_id bigint, text string, title string"))
    assert [r.markdown for r in full.orderBy("doc_id").collect()] == ["the Title here. x", "# Other\n\nbody"]
    blank = spark.createDataFrame([(1, " ", "t")], "doc_id bigint, text string, title string")
    with pytest.raises(Exception, match="no text"):
        readers.parse_fulltext(blank).collect()
    assert tuple(readers.parse_fulltext(blank, strict=False).select("markdown", "error").first()) == (None, "the document has no text")
    bare = io.BytesIO()
    with zipfile.ZipFile(bare, "w") as z:
        z.writestr("n.txt", "n")
    rows = spark.createDataFrame([(1, bytearray(bare.getvalue())), (2, bytearray(b"no zip")), (3, None)], "doc_id bigint, content binary")
    got = {r.doc_id: (r.markdown, r.error) for r in readers.unpack_archives(rows).collect()}
    assert got[1] == (None, "the archive has no markdown") and all(got[i][0] is None and got[i][1] for i in (2, 3))  # a row each, not a failed job


def test_completion_client(spark):
    rows = spark.createDataFrame([("r1", [("user", "hi")])], "request_id string, messages array<struct<role:string,content:string>>")
    got = readers.complete(rows, lambda m: {"content": m[-1]["content"].upper(), "usage": {"prompt": 3}}).first()
    assert (got.content, got.prompt, got.completion) == ("HI", 3, 0)


# streams
def test_stream_equals_its_batch_twin(spark, tmp_path):
    event = lambda s: "data: " + json.dumps({"choices": [{"delta": {"content": s}}]}) + "\n\n"
    whole = ": note\n" + event("spl") + "data: {bad\n" + event("it") + "data: [DONE]\n" + event("late")
    chunks = [("a", i, whole[at : at + 11]) for i, at in enumerate(range(0, len(whole), 11))] + [("b", 0, event("no end"))]
    batch = {r.request_id: (r.text, r.done) for r in sse.reassemble(spark.createDataFrame(chunks, "request_id string, seq int, chunk string")).collect()}
    assert batch == {"a": ("split", True), "b": ("no end", False)}
    order = [c for c in chunks if c[1] % 2] + [c for c in chunks if not c[1] % 2]  # late chunks wait for their turn
    for n, part in enumerate((order[:5], order[5:])):
        spark.createDataFrame(part, "request_id string, seq bigint, chunk string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("request_id string, seq bigint, chunk string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sse.reassemble_stream(stream).writeStream.format("memory").queryName("sse").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {}
    for r in spark.table("sse").collect():
        if len(r.text) >= len(got.get(r.request_id, ("", False))[0]):
            got[r.request_id] = (r.text, r.done or got.get(r.request_id, ("", False))[1])
    assert got == batch


def test_many_searches_equal_the_scan(spark):
    rng = random.Random(21)
    word = lambda n: "".join(rng.choice("aAbé \n") for _ in range(rng.randint(0, n)))
    rows = [(i, word(12), word(30) if i % 5 else None, word(3)) for i in range(80)]
    h = spark.createDataFrame([(*r, *[None] * 5) for r in rows], "id bigint, selected string, context string, result string, item_title string, library_name string, operation string, phonetic string, translation string")
    queries = [(i, word(5)) for i in range(60)] + [(100, None), (101, "  "), (102, "zzz"), (103, " é ")]
    got = sorted(tuple(r) for r in history.search_many(spark.createDataFrame(queries, "query_id int, query string"), h).collect())
    assert got == sorted((q, r.id) for q, text in queries for r in history.search(h, text or "").select("id").collect())
    kept = history.gram_index(h).cache()
    again = history.search_many(spark.createDataFrame(queries, "query_id int, query string"), h, kept)
    assert sorted(tuple(r) for r in again.collect()) == got


def test_first_output_as_of_a_time_equals_the_join(spark):
    rng = random.Random(22)
    day = 86_400_000
    jobs = [(i, rng.choice([1, 1, 2, None]), rng.choice(["t", "t", None]), rng.choice([rng.randint(0, 5 * day), 60_000 + 2 * day, None])) for i in range(150)]
    files = [(i, rng.choice([5, 5, i]), rng.choice([1, 1, 2, None]), "t", rng.choice([rng.randint(0, 4 * day), 2 * day]), rng.choice(["text/html", "x"]), rng.random() < 0.8) for i in range(150)]
    j = spark.createDataFrame(jobs, "job_id bigint, parent_id bigint, title string, created_ms bigint")
    a = spark.createDataFrame(files, "attachment_id bigint, ord bigint, parent_id bigint, title string, added_ms bigint, content_type string, file_exists boolean")
    want = {}
    for i, parent, title, created in jobs:
        fit = [(f[1], f[0]) for f in files if parent is not None and title and created is not None and f[2] == parent and f[3] == title and f[5] == "text/html" and f[6] and f[4] >= created - 60_000]
        if fit:
            want[i] = min(fit)[1]
    assert {r.job_id: r.attachment_id for r in history.output_candidates(j, a).collect()} == want


def micro_batches(spark, tmp_path, schema, parts):
    """A stream that reads one part at a time."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken by age
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run_stream(rows, tmp_path, name, expected=None):
    """Runs until all is read (``expected``: until so many rows are, for a query whose timers keep it going) and returns what is written."""
    spark = rows.sparkSession
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        out = rows.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / "ck"))
        q = (out.trigger(availableNow=True) if expected is None else out).start()
        if expected is None:
            q.awaitTermination(300)
            assert not q.isActive
        else:
            seen, until = {}, time.time() + 300
            while sum(seen.values()) < expected and q.isActive and time.time() < until:
                seen |= {p["batchId"]: p["numInputRows"] for p in q.recentProgress}
                time.sleep(0.2)
            q.stop()
            assert sum(seen.values()) == expected
        assert q.exception() is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    return spark.read.parquet(str(tmp_path / name)).collect()


def test_increments_are_the_answer_and_state_stays_small(spark, tmp_path):
    event = lambda s: "data: " + json.dumps({"choices": [{"delta": {"content": s}}]}) + "\n\n"
    whole = ": note\n" + "".join(event(f"part {i} ") for i in range(40)) + "data: [DONE]\n" + event("late")
    cut = [("a", i, whole[at : at + 37]) for i, at in enumerate(range(0, len(whole), 37))]
    chunks = cut + [("b", 0, event("no end")), ("b", 1, "data: " + json.dumps({"choices": [{"delta": {"content": "tail"}}]}))]
    schema = "request_id string, seq bigint, chunk string"
    batch = {r.request_id: (r.text, r.done) for r in sse.reassemble(spark.createDataFrame(chunks, schema)).collect()}
    order = [c for c in chunks if c[1] % 3] + [c for c in chunks if not c[1] % 3]  # two thirds come early
    stream = micro_batches(spark, tmp_path, schema, (order[:20], order[20:40]))
    assert {r.request_id for r in run_stream(sse.increments_stream(stream, 3_600_000), tmp_path, "out", 40)} <= {"a", "b"}
    # the same query, started again from its checkpoint with what came meanwhile
    micro_batches(spark, tmp_path, schema, (order[40:], [("z", 0, "x")]))
    got = run_stream(sse.increments_stream(stream, 3_600_000), tmp_path, "out", len(order) - 39)
    text = {k: "".join(r.increment for r in sorted((r for r in got if r.request_id == k), key=lambda r: r.at)) for k in batch}
    assert text["a"] == batch["a"][0] and text["b"] == "no end" and not any(r.expired for r in got)  # the tail of b is an unfinished line
    assert [r.done for r in got if r.request_id == "a" and r.done]


def test_increments_without_expiry_equal_the_batch_twin(spark):
    class Value:
        held = None
        exists = lambda self: self.held is not None
        get = lambda self: self.held

        def update(self, v):
            self.held = v

        def clear(self):
            self.held = None

    class Map(dict):
        containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.__delitem__  # noqa: N815

    class Handle:
        timers: set = set()
        getValueState = lambda self, *a: Value()  # noqa: N815, E731
        getMapState = lambda self, *a: Map()  # noqa: N815, E731
        registerTimer = lambda self, t: self.timers.add(t)  # noqa: N815, E731
        deleteTimer = lambda self, t: self.timers.discard(t)  # noqa: N815, E731

    class Now:
        at = 0
        getCurrentProcessingTimeInMs = lambda self: self.at  # noqa: N815, E731

    import pandas as pd

    rng = random.Random(5)
    event = lambda s: "data: " + json.dumps({"choices": [{"delta": {"content": s}}]}) + "\n"
    for ends in (True, False):
        whole = "".join(event("x" * rng.randint(0, 9) + "é") for _ in range(300)) + ("data: [DONE]\n" + event("late") if ends else event("tail").strip())
        chunks = [(i, whole[at : at + 50]) for i, at in enumerate(range(0, len(whole), 50))]
        want = sse.reassemble(spark.createDataFrame([("r", *c) for c in chunks], "request_id string, seq int, chunk string")).first()
        chunks = [c for k in range(0, len(chunks), 8) for c in rng.sample(chunks[k : k + 8], len(chunks[k : k + 8]))] + [chunks[0]]
        machine, now, rows, largest = sse.Increments(1000), Now(), [], 0
        machine.init(Handle())
        for k in range(0, len(chunks), 5):
            now.at += 10
            rows += [r for f in machine.handleInputRows(("r",), iter([pd.DataFrame(chunks[k : k + 5], columns=["seq", "chunk"])]), now) for r in f.itertuples()]
            largest = max(largest, len(machine.line.get()[0]) + sum(len(v[0]) for v in machine.early.values()))
            assert len(Handle.timers) == 1
        rows += [r for f in machine.handleExpiredTimer(("r",), now, None) for r in f.itertuples()]
        assert "".join(r.increment for r in rows) == want.text and rows[-1].done == want.done and rows[-1].expired
        assert largest < 9 * 50 + 100 and machine.line.get() is None and not machine.early  # an unfinished line and the chunks of one window
        Handle.timers.clear()


def test_settled_stream_equals_the_last_selections(spark, tmp_path):
    rng = random.Random(6)
    rows = sorted({(f"r{rng.randint(0, 3)}", rng.randint(0, 3000)) for _ in range(150)}, key=lambda r: (r[1], r[0]))
    stamp = lambda ms: f"2024-01-01 00:00:{ms // 1000:02d}.{ms % 1000:03d}"
    batch = sse.last_selection(spark.createDataFrame(rows, "reader string, at_ms bigint"))
    want = {(r.reader, r.at_ms) for r in batch.collect()}
    late = [rows[i] for i in range(len(rows)) if i % 10 == 3]
    order = [r for r in rows if r not in late]
    parts = [order[:60] , late[:6] + order[60:], late[6:], [("end", 20_000)], [("end", 40_000)]]
    make = lambda part: [(k, datetime.datetime.fromisoformat(stamp(ms)), ms) for k, ms in part]
    stream = micro_batches(spark, tmp_path, "reader string, at timestamp, ms bigint", [make(p) for p in parts])
    got = run_stream(sse.settled_stream(stream, "reader", "at", late_ms=5000), tmp_path, "out")
    assert {(r.reader, r.ms) for r in got if r.reader != "end"} == want and len(got) == len({(r.reader, r.ms) for r in got})


def test_writers_at_once_lose_nothing_and_cut_off_saves_are_invisible(spark, tmp_path):
    path, schema = f"file://{tmp_path}/log", "id bigint, v string"
    make = lambda rows: spark.createDataFrame(rows, schema).coalesce(1)
    state = lambda: {r.id: r.v for r in versions.latest(spark, path, schema, ["id"]).collect()}
    assert state() == {}
    numbers = []
    threads = [threading.Thread(target=lambda k=k: numbers.append(versions.append(make([(k, f"a{k}"), (99, f"x{k}")]), path))) for k in range(6)]
    for th in threads:
        th.start()
    for th in threads:
        th.join()
    assert sorted(numbers) == [1, 2, 3, 4, 5, 6]
    got = state()
    assert {k: got[k] for k in range(6)} == {k: f"a{k}" for k in range(6)} and got[99].startswith("x")
    make([(0, "never committed")]).withColumn("gone", F.lit(False)).write.parquet(f"{path}/data/batch=cut")
    (tmp_path / "log/commits/00000000000000000007").write_text("")  # a commit that was cut off
    assert state() == got
    assert versions.append(make([(0, "b0")]), path) == 8 and state() == got | {0: "b0"}
    assert versions.compact(spark, path, schema, ["id"], 0.9) is None and versions.compact(spark, path, schema, ["id"], 0.1) == 9
    assert state() == got | {0: "b0"} and versions.versions(spark, path, schema).count() == 7
    versions.append(make([(5, "")]).withColumn("gone", F.lit(True)), path)
    assert 5 not in state() and versions.vacuum(spark, path) == 8 and 5 not in state() and len(state()) == 6
