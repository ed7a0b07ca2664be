"""Properties that must hold for any input."""

import random
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import text as fx
from quire.operators import automaton, batching, context, lexicon, protocol, structure
from tests import structure_by_hand


def test_batches_keep_order_and_limits(spark):
    rng = random.Random(11)
    sizes = {d: [rng.randint(0, 60) for _ in range(rng.randint(1, 40))] for d in range(60)}
    rows = spark.createDataFrame([(d, i, f"b{i}", n) for d, ns in sizes.items() for i, n in enumerate(ns)], "doc_id bigint, pos int, id string, size int")
    got: dict = {}
    for r in batching.plan_batches(rows, 100, 6).orderBy("doc_id", "batch_no").collect():
        got.setdefault(r.doc_id, []).append((r.block_ids, r.char_count))
    for d, ns in sizes.items():
        assert [i for ids, _ in got[d] for i in ids] == [f"b{i}" for i in range(len(ns))]
        at = 0
        for k, (ids, chars) in enumerate(got[d]):
            assert chars == sum(ns[at : at + len(ids)]) and len(ids) <= 6 and (chars <= 100 or len(ids) == 1)
            at += len(ids)
            if k + 1 < len(got[d]):  # greedy: the next block wouldn't have fitted
                assert chars + ns[at] > 100 or len(ids) == 6


kinds = st.sampled_from(["paragraph", "heading", "table", "image", "caption"])
sources = st.sampled_from(["Open end", "lower start.", "lower open,", "Done.", "Table 3", "", "x" * 300])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(kinds, sources), max_size=12))
def test_repair_is_idempotent_and_loses_no_text(items):
    blocks = [{"id": f"b{i}", "type": k, "source": s, "status": "pending"} for i, (k, s) in enumerate(items)]
    once, into, gone = structure.repair(blocks)
    assert structure.repair(once)[1] == [] and len(once) + len(gone) == len(blocks) and len(into) == len(gone)
    assert sorted("".join(b["source"] for b in once).replace(" ", "")) == sorted("".join(b["source"] for b in blocks).replace(" ", ""))


def test_spans_go_back_in_reverse(spark):
    rng = random.Random(5)
    sources = ["".join(rng.choice("ab `$<>/()[]1290.\nhtps:@") for _ in range(rng.randint(0, 60))) for _ in range(600)]
    sources += ["", "`a` <b> $c$ https://d.e (f 2019) `g`", "$$x\ny$$ ```\ncode``` 10.1234/AbC.d", "(see https://x.org 1999) Smith and Jones (2001)"]
    rows = protocol.protect_texts(spark.createDataFrame([(i, t) for i, t in enumerate(sources)], "i int, source string"))
    back = protocol.restore(F.col("protected"), F.col("spans"), nested=True)
    for r in rows.withColumn("r", back).collect():
        text = r.protected
        for token, value in reversed(r.spans):
            assert text.count(token) == 1
            text = text.replace(token, value)
        assert text == sources[r.i] and (r.r.text, r.r.lost) == (text.strip(), None)


def split_by_hand(text: str) -> list[str]:
    """Sentences token by token, as the rule is told."""
    out, own, words = [], "", re.findall(r"\s*\S+", text)
    for i, raw in enumerate(words):
        own += raw
        token = raw.strip()
        word = token[:-1].lower()
        if token[-1] not in ".?!" or word in fx.ABBREVIATIONS or word.removesuffix(".") in fx.ABBREVIATIONS:
            continue
        if i and f"{words[i - 1].strip().lower()} {word}" in fx.ABBREVIATIONS:
            continue
        if re.fullmatch(r"\d+\.\d*", re.sub(r"[?!]$", "", token), re.A) or re.search(r"\d+\.\d+", token, re.A):
            continue
        out.append(own.strip())
        own = ""
    return out + [own.strip()] * bool(own.strip())


def test_sentences_equal_the_rule(spark):
    rng = random.Random(9)
    parts = ["one", "et", "al.", "Al.", "Fig.", "e.g.", "end.", "what?", "No!", "3.", "0.05", "v2.1.", "(e.g.", "no..", "x\u0000y.", ".", "etal.", "p.5", "1.?", "dr.!", "Et"]
    gaps = [" ", "\n", " " * 80, "\t \n"]
    texts = ["".join(rng.choice(parts) + rng.choice(gaps) for _ in range(rng.randint(0, 25))) for _ in range(400)] + ["et" + " " * 80 + "al. x", "  lead. in", "a.b.c", "", "x" * 50_000 + ". y"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    got = {r.i: r.s for r in rows.select("i", fx.split_sentences(F.col("v")).alias("s")).collect()}
    assert all(got[i] == split_by_hand(t) for i, t in enumerate(texts))


def test_terms_between_borders_equal_the_pattern(spark):
    rng = random.Random(4)
    letters = ["a", "b", "ab", "Ab", "1", "é", "ſ", "K", "k", "s", " ", "-", ".", "+", "语", "("]
    word = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(1, n)))
    terms = sorted({w for _ in range(150) if (w := word(4)).strip()})
    texts = [word(40) for _ in range(150)] + [""]
    glossary = spark.createDataFrame([(d, i, w, w, None, None) for d in (1, 2) for i, w in enumerate(terms) if d == 1 or i % 3], "library_id bigint, ord bigint, term string, translation string, field string, note string")
    rows = spark.createDataFrame([(i, 1 + i % 3, t) for i, t in enumerate(texts)], "i bigint, library_id bigint, text string")
    found = lambda t, w: rows and re.search(rf"(?:^|[^A-Za-z0-9]){re.escape(w)}(?:\Z|[^A-Za-z0-9])", t, re.I)
    for r in lexicon.match_bounded(rows, glossary, 1000, keys=("i",)).collect():
        own = [w for i, w in enumerate(terms) if r.library_id == 1 or r.library_id == 2 and i % 3]
        assert r.terms == [w for w in own if found(texts[r.i], w)], (r.i, r.library_id)


def test_tiered_terms_equal_the_rule(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice(["a", "B", "b", "é", " ", "\n", ".", "语"]) for _ in range(rng.randint(0, n)))
    terms = sorted({word(3) for _ in range(60)})
    glossary = spark.createDataFrame([(d, 2 * i, w, w, None, None) for d in (1, 2) for i, w in enumerate(terms) if d == 1 or i % 3], "library_id bigint, ord bigint, term string, translation string, field string, note string")
    rows = [(i, 1 + i % 3, word(5) if i % 9 else None, word(12) if i % 7 else None) for i in range(120)]
    frame = spark.createDataFrame(rows, "i bigint, library_id bigint, selected string, context string")
    for keys, limit in ((("i",), 1 << 18), (("library_id", "selected", "context"), 1 << 18), (("i",), 16), (("library_id", "selected", "context"), 1)):
        found = lexicon.match_tiered(frame.repartition(3), glossary, 20, keys, limit).collect()
        assert len(found) == len(rows)
        for r in found:
            own = [w for i, w in enumerate(terms) if r.library_id == 1 or r.library_id == 2 and i % 3]
            s, c = (r.selected or "").lower(), (r.context or "").lower()
            assert [e.term for e in r.terms] == ([w for w in own if w.lower() in s] + [w for w in own if w.lower() not in s and w.lower() in c])[:20]


def test_automaton_finds_every_substring():
    rng = random.Random(8)
    for letters, longest in (("ab", 9), ("abcé语🤖", 5), ("a", 30)):
        word = lambda n: "".join(rng.choice(letters) for _ in range(n))  # noqa: B023, E731
        terms = list({word(rng.randint(1, longest)) for _ in range(60)})
        texts = [word(rng.randint(0, 80)) for _ in range(200)] + ["", word(20_000)]
        raw = [t.encode() for t in texts]
        rows, hits = automaton.Automaton(terms).hits(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        got = set(zip(rows.tolist(), hits.tolist()))
        assert got == {(i, j) for i, t in enumerate(texts) for j, w in enumerate(terms) if w in t} and len(got) == len(rows)


def test_automaton_reads_a_million_characters_without_a_space_at_once():
    rng = random.Random(9)
    terms = list({"".join(rng.choices("abcdefghij日本語", k=rng.randint(2, 12))) for _ in range(3000)})
    text = "".join(rng.choices("abcdefghij日本語", k=1_000_000))
    machine, began = automaton.Automaton(terms), time.process_time()
    _, hits = machine.hits(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    assert time.process_time() - began < 2 and set(hits.tolist()) == {i for i, w in enumerate(terms) if w in text}


def test_phrases_stand_where_the_pattern_finds_them(spark):
    """Terms of up to four runs over few letters: overlaps, repeats, gaps at either end of a text and of a term."""
    rng = random.Random(14)
    word = lambda n, parts: "".join(rng.choice(parts) for _ in range(rng.randint(1, n)))
    parts = ["a", "b", "aa", " ", " ", "-", "É", "(", ", "]
    terms = sorted({w for _ in range(300) if len(re.findall("[a-z]+", w := word(8, parts))) > 1})
    texts = [word(60, [*parts, "é", "A"]) for _ in range(150)] + ["", None, terms[0], f"({terms[1]})", "a " * 3000]
    glossary = spark.createDataFrame([(1, i, w) for i, w in enumerate(terms)], "library_id bigint, ord bigint, term string")
    rows = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "i bigint, library_id bigint, text string")
    for r in lexicon.match_bounded(rows, glossary, 1000, keys=("i",)).collect():
        assert r.terms == [w for w in terms if re.search(rf"(?:^|[^A-Za-z0-9]){re.escape(w)}(?:\Z|[^A-Za-z0-9])", texts[r.i] or "", re.I)], r.i


def test_spans_of_ten_thousand_tokens_come_back_in_linear_time(spark):
    took = []
    for n in (1000, 10_000):
        source = " ".join(f"a (see https://x.y/{i} in 2020) `c{i}`" for i in range(n // 3))
        rows = protocol.protect_texts(spark.createDataFrame([(source,)], "source string")).cache()
        began = time.time()
        back = rows.select("source", protocol.restore(F.col("protected"), F.col("spans"), nested=True).alias("r")).first()
        took.append(time.time() - began)
        assert back.r.text == source and back.r.lost is None
    assert took[1] < 10 * took[0] + 5


def test_spans_inside_spans_equal_replacing_from_the_last(spark):
    """Random forests, tokens missing and foreign, tokens that are no older than their span."""
    rng, rows, want = random.Random(12), [], {}
    token = lambda i: f"⟦{'CODE URL CIT'.split()[i % 3]}_{i}⟧"
    for k in range(200):
        n = rng.randint(0, 9)
        level = sorted(rng.randint(0, 3) for _ in range(n))
        spans = [(token(i), "".join(["v", *(token(j) for j in range(i) if level[j] < level[i] and rng.random() < 0.4), *([token(i), token(n + 3)] if rng.random() < 0.1 else [])])) for i in range(n)]
        text = " ".join(token(i) for i in range(n + 1) if rng.random() < 0.9)
        rows.append((k, text, spans))
        lost = None
        for name, value in reversed(spans):
            if name not in text:
                lost = name
                break
            text = text.replace(name, value)
        want[k] = (None if lost else text.strip(), lost)
    frame = spark.createDataFrame(rows, "k int, text string, spans array<struct<token:string,value:string>>")
    got = frame.select("k", protocol.restore(F.col("text"), F.col("spans"), nested=True).alias("r")).collect()
    assert {r.k: (r.r.text, r.r.lost) for r in got} == want


def test_sanitizing_and_stitching(spark):
    rng = random.Random(2)
    parts = ["[TYPE=title] ", "TYPE: quote\n", "text ", "**", "\n", "TYPE"]
    rows = spark.createDataFrame([("".join(rng.choice(parts) for _ in range(rng.randint(0, 4))),) for _ in range(200)], "v string")
    once = fx.sanitize(F.col("v"))
    assert rows.where(fx.sanitize(once) != once).count() == 0
    pages = [(d, p, [rng.choice(["Abc.", "abc", "Abc", "z."]) for _ in range(rng.randint(0, 3))]) for d in range(20) for p in range(1, 5) if rng.random() < 0.8]
    frame = spark.createDataFrame(pages, "doc_id bigint, page int, paragraphs array<string>")
    got = {(r.doc_id, r.page): len(r.paragraphs) for r in context.stitch_pages(frame).collect()}
    assert got == {(d, p): len(ps) for d, p, ps in pages}


def test_pieces_of_long_documents_equal_the_fold(spark):
    rng = random.Random(41)
    sizes = {d: [rng.choice([0, 1, 5, 40, 99, 100, 101, 400]) for _ in range(n)] for d, n in ((1, 3000), (2, 1), (3, 64), (4, 65), (5, 700))}
    rows = spark.createDataFrame([(d, 7 * i, f"b{i}", n) for d, ns in sizes.items() for i, n in enumerate(ns)], "doc_id bigint, pos bigint, id string, size int").repartition(4)
    for blocks, split in ((6, 64), (20, 20), (1, 50)):
        want = {(r.doc_id, r.batch_no, r.id, tuple(r.block_ids), r.char_count) for r in batching.plan_batches(rows, 100, blocks).collect()}
        got = [(r.doc_id, r.batch_no, r.id, tuple(r.block_ids), r.char_count) for r in batching.plan_batches(rows, 100, blocks, split).collect()]
        assert len(got) == len(want) and set(got) == want, (blocks, split)


def test_windows_over_lines_equal_the_sequential_rule(spark):
    """Random lines of fences, tables, headings, images, references and text, against the machine that reads them one by one."""
    rng = random.Random(31)
    lines = ["```", "  ```py", "<table>", "</table>", "x <TABLE a><tr></table> y", "", "  ", "plain words here", "# Top", "## References", "### sub", "References", "Ann Lee, Bo Ray", "University of X", "![a](b/p.png) cap", "![a](<p.png>)", "> q", ">  r", "$$ x+y $$", "| a |", "|---|", "Table 1. c", "Smith, A. One.", "Downloaded from y", "long " * 70 + ".", "a\\*b\\_", "﻿", "Ends."]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 25))) for _ in range(400)] + [None, "", "```", "\r\na\rb\r\n\r\nc"]
    assets = [("x/b/p.png", "assets/1.png"), ("p.png", "assets/2.png")]
    rows = spark.createDataFrame([(i, t, assets if i % 3 else None) for i, t in enumerate(texts)], "doc_id bigint, markdown string, assets array<struct<original_path:string,relative_path:string>>").repartition(5)
    got: dict = {}
    for r in structure.structure_documents(rows, repaired=False).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.id, r.type, r.source, r.asset_path, r.source_asset_path, r.status))
    for i, t in enumerate(texts):
        own = [{"original_path": a, "relative_path": b} for a, b in assets] if i % 3 else []
        want = [(n, b["id"], b["type"], b["source"], b["asset_path"], b["source_asset_path"], b["status"]) for n, b in enumerate(structure_by_hand.classify(structure_by_hand.segments((t or "").replace("﻿", " ")), own))]
        assert [(*x[:3], x[3].replace("﻿", " ").strip(), *x[4:]) for x in got.get(i, [])] == want, (i, t)


def test_linked_repair_equals_popping(spark):
    rng = random.Random(32)
    draw = lambda i: {"id": f"b{i}", "type": rng.choice(["paragraph"] * 5 + ["table", "image", "caption", "heading"]), "source": rng.choice(["Opens here,", "goes on", "then ends.", "Whole.", "", "Table 1", "x" * 300, "and so,"])}
    for _ in range(500):
        blocks = [draw(i) for i in range(rng.randint(0, 14))]
        rest, into, at = [dict(b) for b in blocks], [], 0
        while at < len(rest):
            to = structure.continuation_of(rest, at)
            if to is None:
                at += 1
            else:
                rest[at]["source"] = structure.joined(rest[at]["source"], rest.pop(to)["source"])
                into.append(rest[at]["id"])
        assert structure.repair(blocks, reindex=False)[:2] == (rest, into)
