"""Vector codes, line deduplication and the prefix trie against brute force, on hard rows and on hot keys."""

import hashlib
import random
from collections import defaultdict
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import linededup, oracles, prefixtrie, vectorcodes
from quire.llm._common import materialize

VECTORS = "vec_id bigint, embedding array<float>, label int, code string, error string, c0 int"
SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11 vector codes -----------------------------------------------------------------------------------------------------
def books_by_hand(rows, parts=8, entries=16, rounds=6):
    """Plain Python integers: (vec_id, vector) to codes, errors and codebooks."""
    ints = [(i, [int(np.floor(np.float64(x) * 4096)) for x in v]) for i, v in rows]
    width = len(ints[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[cut(v, p) for _, v in sorted(ints)[:entries]] for p in range(parts)]
    near = lambda v, book: min(range(len(book)), key=lambda e: (far(v, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v in ints:
                groups[near(cut(v, p), books[p])].append(cut(v, p))
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else b for e, b in enumerate(books[p])]
    out = {}
    for i, v in ints:
        code = [near(cut(v, p), books[p]) for p in range(parts)]
        out[i] = ("".join(f"{c:02x}" for c in code), sum(far(cut(v, p), books[p][c]) for p, c in enumerate(code)))
    return out, books


@pytest.mark.parametrize("kind", ["noise", "grid", "few", "large"])
def test_codes_match_plain_integers(spark, kind):
    """The grid has many exact ties and repeated vectors, "few" fewer vectors than entries, "large" numbers that float32 can't tell apart."""
    r = random.Random(kind)
    draw = {"noise": lambda: r.gauss(0, 0.2), "few": lambda: r.gauss(0, 0.2), "grid": lambda: r.choice((-1, 0, 1)) / 4096, "large": lambda: 8000 + r.randrange(64) / 4096 / 2}[kind]
    rows = [(i * 3 - 50, [float(np.float32(draw())) for _ in range(32)]) for i in range(9 if kind == "few" else 180)]
    table = spark.createDataFrame([(i, v, i % 3, "x", "y", 1) for i, v in rows], VECTORS).repartition(3)
    want, want_books = books_by_hand(rows)
    books = vectorcodes.codebooks(table)
    assert [b.tolist() for b in books] == want_books
    got = vectorcodes.encode(table, books)
    assert got.columns == ["vec_id", "embedding", "label", "c0", "code", "error"]
    assert {x.vec_id: (x.code, x.error) for x in got.collect()} == want
    assert vectorcodes.digest(books) == sha(",".join(str(x) for b in want_books for e in b for x in e))


def test_screening_decides_all_but_close_entries():
    """The interval is never wrong, ties go to the lower index, and few entries are evaluated again where distances differ."""
    r = np.random.default_rng(5)
    for scale, shift in ((1500, 0), (3, 0), (1 << 20, 1 << 24), (40, 1 << 26)):
        x, book = (r.integers(-scale, scale + 1, (n, 8)) + shift for n in (4000, 16))
        book[7] = book[3]
        code, error, again = vectorcodes.nearest(x, book)
        exact = ((x[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        assert (code == exact.argmin(axis=1)).all() and (error == exact.min(axis=1)).all() and not (code == 7).any()
        if scale == 1500:
            assert again < 0.3 * 16 * len(x)


def test_codes_of_hard_rows(spark):
    good = [(i, [float(i), 0.5, -0.25, 1.0] * 4, None if i % 2 else 7, None, None, 0) for i in range(20)]
    odd = [(100, None, 1, None, None, 0), (101, [1.0, None] * 8, 1, None, None, 0), (102, [float("nan")] * 16, 1, None, None, 0), (103, [float("inf")] * 16, 1, None, None, 0), (104, [], 1, None, None, 0), (105, [1.0] * 3, 1, None, None, 0)]
    same = [(None, [0.5] * 16, 7, None, None, 0), (3, [2.0] * 16, 7, None, None, 0), (3, [2.0] * 16, 7, None, None, 0), (9, [3e38] * 16, 7, None, None, 0)]
    table = spark.createDataFrame(good + odd + same, VECTORS)
    books = vectorcodes.codebooks(table)
    rows = vectorcodes.encode(table, books).collect()
    assert len(rows) == len(good) + len(same) and all(len(x.code) == 16 and x.error >= 0 for x in rows) and not {x.vec_id for x in rows} & {r[0] for r in odd}
    near = vectorcodes.decode(vectorcodes.encode(table.where("vec_id < 3"), books), books).collect()
    assert all(max(abs(a - b) for a, b in zip(x.approximate, x.embedding)) < 3 for x in near)
    none = spark.createDataFrame([], VECTORS)
    assert vectorcodes.codebooks(none) == [] and vectorcodes.encode(none, []).count() == 0 and vectorcodes.codebooks(spark.createDataFrame(odd, VECTORS).where("vec_id in (100, 104)")) == []


# 12 lines ------------------------------------------------------------------------------------------------------------
def lines_by_hand(rows, least=5, chars=40):
    key = lambda line: line.strip(SPACE).translate(LOWER)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= chars:
                holders[key(line)].add(i)
    keeper = {k: max(v, key=lambda i: (i is not None, i or 0)) for k, v in holders.items() if len(v) >= least}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_lines_match_brute_force(spark, docs):
    r = random.Random(3)
    common = [f"{w} this very line is shared by quite a few documents {w}" for w in ("Ä", "B", "É", "日本", "\x1f")]
    texts = ["\n".join(r.choice((f"\t{r.choice(common)} ", r.choice(common).upper(), "short", "", f"own line {r.random()} of a document, long enough"))for _ in range(r.randrange(12))) for _ in range(60)]
    table = docs(texts + ["\n", None, "", "x\r\ny"]).repartition(3)
    got = linededup.drop_common_lines(table)
    assert got.columns == [*table.columns, "n_lines", "n_dropped"]
    want = lines_by_hand([(x.doc_id, x.text) for x in table.collect()])
    assert sorted([(x.doc_id, x.text, x.n_lines, x.n_dropped) for x in got.collect()], key=repr) == want
    assert sum(w[3] for w in want) > 50


def test_lines_of_hard_rows(spark, hard, empty):
    line = "Every one of these documents holds this line, twice or more often."
    clash = "doc_id long, text string, n_lines string, N_Dropped int, r1 int, h1 int, lost string, pos int, line string, key string"
    long = "\n".join([f"unique line number {i} of a text that has very many of them" if i % 2 else line for i in range(60_000)])
    rows = [(i, f"{line}\nrow {i}\n{line}", "x", 1, 1, 1, "l", 1, "n", "k") for i in (1, 2, 3, 3, None, None)] + [(7, long, "x", 1, 1, 1, "l", 1, "n", "k"), (9, "a" * 2_000_000, "x", 1, 1, 1, "l", 1, "n", "k")]
    table = spark.createDataFrame(rows, clash)
    got = linededup.drop_common_lines(table)
    assert got.columns == ["doc_id", "text", "r1", "h1", "lost", "pos", "line", "key", "n_lines", "n_dropped"]
    assert sorted([(x.doc_id, x.text, x.n_lines, x.n_dropped) for x in got.collect()], key=repr) == lines_by_hand([r[:2] for r in rows])
    assert linededup.drop_common_lines(hard).count() == hard.count() and linededup.drop_common_lines(empty).count() == 0


def test_lines_have_no_python_in_their_plans(spark):
    import inspect

    assert not any(word in inspect.getsource(linededup) for word in ("InArrow", "InPandas", "udf", "rdd", "collect()"))


# 13 prefix trie ------------------------------------------------------------------------------------------------------
def trie_by_hand(rows):
    """Recursion over tuples of turns; rows are (conv_id, turn, role, text)."""
    turns = defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append(((n is not None, n or 0), hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    new = {}
    for c, own in turns.items():
        h = crc32(str(c).encode()) % 9
        new[c] = tuple(turns.get(c - int(np.fmod(c, 5)), [])[:h] + own[h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, seq in new.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
            if d:
                kids[seq[: d - 1]].add(seq[:d])
    out = []

    def under(node):
        leaves, saved = (0 if kids[node] else 1), (len(members[node]) - 1) * len(node[-1][1].encode() if node else b"")
        for child in list(kids[node]):
            more = under(child)
            leaves, saved = leaves + more[0], saved + more[1]
        ends = ",".join(map(str, sorted(c for c in members[node] if len(new[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(kids[node]), leaves, saved, sha(ends)))
        return leaves, saved

    if members:
        under(())
    return sorted(out, key=repr)


TALK = "conv_id bigint, turn bigint, role string, text string, depth int, part string, p1 int"


def talk(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2) for r in rows], TALK)


def test_trie_matches_recursion(spark):
    r = random.Random(11)
    rows = [(c, t, r.choice(("user", "bot", None)), r.choice(("yes", "no", "", None, "日本"))) for c in [*range(-12, 90), 1 << 40] if c % 7 for t in range(r.randrange(1, 13))]
    rows += [(4, None, "user", "first"), (4, None, "user", "first"), (4, 2, "user", "tie"), (4, 2, "bot", "tie"), (None, 1, "user", "of none"), (11, 3, "u", "x" * 500_000)]
    r.shuffle(rows)
    got = prefixtrie.prefix_trie(talk(spark, rows).repartition(3))
    assert sorted([tuple(x) for x in got.collect()], key=repr) == trie_by_hand(rows)


def test_trie_of_hot_conversations(spark):
    """Hundreds of equal conversations, one of many turns, and conversations whose turns all go."""
    rows = [(c, t, "user", f"same {t}") for c in range(0, 1500, 5) for t in range(3)]
    rows += [(3, t, "user", f"turn {t % 7}") for t in range(700)] + [(c, 0, "user", "lost") for c in range(2001, 2900, 5)]
    got = prefixtrie.prefix_trie(talk(spark, rows).repartition(4))
    assert sorted([tuple(x) for x in got.collect()], key=repr) == trie_by_hand(rows)


def test_trie_of_nothing(spark):
    assert prefixtrie.prefix_trie(talk(spark, [])).count() == 0
    assert prefixtrie.prefix_trie(talk(spark, [(None, 1, "a", "b")])).count() == 0
    one = [(2, 1, None, None)]
    assert [tuple(x) for x in prefixtrie.prefix_trie(talk(spark, one)).collect()] == trie_by_hand(one)


def test_partial_tries_merge_in_any_grouping(spark):
    rows = [(c, t, "u", str((c * 7 + t * t) % 3)) for c in range(120) for t in range(6)]
    turns, _ = prefixtrie.rebuilt(talk(spark, rows))
    paths = materialize(prefixtrie.prefixes(turns).withColumn("part", F.col("conv_id") % 40), "paths")
    tables = [prefixtrie.merge_tries(prefixtrie.partial_tries(paths), fan_in) for fan_in in (2, 7, 64)]
    assert len({frozenset(map(tuple, t.collect())) for t in tables}) == 1


def test_running_sums_over_keys_that_span_ranges(spark):
    rows = [(k, i, (k * 31 + i) % 17) for k, n in ((1, 3), (2, 5000), (3, 1), (4, 4000), (5, 2)) for i in range(n)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefixtrie.running(spark.createDataFrame(rows, "k long, i long, v long").repartition(5), "k", ["i"], ["v"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, total = set(), {}
    for k, i, v in rows:
        total[k] = total.get(k, 0) + v
        want.add((k, i, total[k], i + 1))
    assert {(x.k, x.i, x.v, x.nth) for x in got} == want and len({x.part for x in got if x.k == 2}) > 1


def test_sql_agrees_on_hard_conversations(spark):
    rows = [(c, t if t % 4 else None, None if t % 3 else "user", None if t % 5 else f"{c % 2}é") for c in (0, 1, 2, 3, 7, 10, 12, 13) for t in range(c + 1)]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    want = con.execute(f"SELECT {', '.join(names)} FROM ({oracles.PREFIXES})").fetchall()
    assert sorted(want, key=repr) == trie_by_hand(rows) == sorted([tuple(x[n] for n in names) for x in prefixtrie.prefix_trie(talk(spark, rows)).collect()], key=repr)
