"""The document operators wired to the driver's tables, each with the SQL that states the same result.

Where the raw texts never make a rule fire, both sides build the same rows from them first (an altered ending, a
planted token).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as fx
from quire.operators import batching, context, history, jobs, layout, lexicon, prompt, protocol, render, structure, validate
from quire.streaming import sse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
# building blocks of the SQL side
LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)"
TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def long(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


@query("paragraph_scan", f"WITH {LINES} SELECT doc_id, pos::BIGINT AS pos, length(line)::BIGINT AS chars FROM lines WHERE {TRIM.format('line')} <> ''")
def paragraph_scan(spark, sf):
    return doc_lines(spark, sf).where(fx.js_trim(F.col("line")) != "").select("doc_id", long("pos").alias("pos"), long(fx.js_length(F.col("line"))).alias("chars"))


def _batch_sql(chars: int, blocks: int, tail: str) -> str:
    full = f"r.chars + l.len > {chars} OR r.n >= {blocks}"
    return f"""WITH RECURSIVE {LINES}, l AS (SELECT doc_id, pos, length(line) AS len, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM lines WHERE {TRIM.format('line')} <> ''),
    r AS (SELECT doc_id, rn, pos, len, 1 AS batch_no, len AS chars, 1 AS n FROM l WHERE rn = 1 UNION ALL
      SELECT l.doc_id, l.rn, l.pos, l.len, CASE WHEN {full} THEN r.batch_no + 1 ELSE r.batch_no END, CASE WHEN {full} THEN l.len ELSE r.chars + l.len END, CASE WHEN {full} THEN 1 ELSE r.n + 1 END
      FROM r JOIN l ON l.doc_id = r.doc_id AND l.rn = r.rn + 1),
    b AS (SELECT doc_id, batch_no::BIGINT AS batch_no, printf('batch-%03d', batch_no) AS id, count(*)::BIGINT AS n_blocks, printf('b%04d', min(pos) + 1) AS first_block, printf('b%04d', max(pos) + 1) AS last_block, sum(len)::BIGINT AS char_count FROM r GROUP BY doc_id, batch_no) {tail}"""


def _batches(spark, sf, chars, blocks):
    rows = doc_lines(spark, sf).where(fx.js_trim(F.col("line")) != "").select("doc_id", "pos", F.format_string("b%04d", F.col("pos") + 1).alias("id"), fx.js_length(F.col("line")).alias("size"))
    return batching.plan_batches(rows, chars, blocks)


@query("batch_plan", _batch_sql(400, 5, "SELECT * FROM b"))
def batch_plan(spark, sf):
    return _batches(spark, sf, 400, 5).select("doc_id", long("batch_no").alias("batch_no"), "id", long(F.size("block_ids")).alias("n_blocks"), F.get("block_ids", F.lit(0)).alias("first_block"), F.element_at("block_ids", -1).alias("last_block"), "char_count")


@query("batch_plan_docs", _batch_sql(24000, 20, "SELECT doc_id, count(*)::BIGINT AS batches, sum(n_blocks)::BIGINT AS blocks, max(char_count)::BIGINT AS largest FROM b GROUP BY doc_id"))
def batch_plan_docs(spark, sf):
    plan = _batches(spark, sf, batching.MAX_CHARS, batching.MAX_BLOCKS)
    return plan.groupBy("doc_id").agg(F.count(F.lit(1)).alias("batches"), F.sum(long(F.size("block_ids"))).alias("blocks"), F.max("char_count").alias("largest"))


# all lines of all documents as the blocks of one document, in pieces of 512
@query("batch_plan_long", _batch_sql(24000, 20, "SELECT batch_no, id, n_blocks, first_block, last_block, char_count FROM b").replace(LINES, "raw AS (SELECT doc_id AS d, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS p FROM documents), lines AS (SELECT 0 AS doc_id, line, d * 1000000 + p AS pos FROM raw)").replace("printf('b%04d', min(pos) + 1)", "printf('b%d', min(pos))").replace("printf('b%04d', max(pos) + 1)", "printf('b%d', max(pos))"))
def batch_plan_long(spark, sf):
    rows = doc_lines(spark, sf).where(fx.js_trim(F.col("line")) != "").select(F.lit(0).cast("bigint").alias("doc_id"), (F.col("doc_id") * 1000000 + F.col("pos")).alias("pos"), F.format_string("b%d", F.col("doc_id") * 1000000 + F.col("pos")).alias("id"), fx.js_length(F.col("line")).alias("size"))
    plan = batching.plan_batches(rows, split=512)
    return plan.select(long("batch_no").alias("batch_no"), "id", long(F.size("block_ids")).alias("n_blocks"), F.get("block_ids", F.lit(0)).alias("first_block"), F.element_at("block_ids", -1).alias("last_block"), "char_count")


@query("context_level", rf"""WITH s AS (SELECT conv_id, turn, {TRIM.format('text')} AS t FROM conversations), c AS (SELECT *, len(regexp_split_to_array(t, '\s+')) AS words, len(regexp_extract_all(t, '[.?!]\s')) + CASE WHEN regexp_matches(t, '[.?!]$') THEN 1 ELSE 0 END AS ends FROM s)
SELECT conv_id, turn, CASE WHEN t = '' OR words <= 3 THEN 1 WHEN ends >= 2 THEN 3 ELSE 2 END AS level FROM c""")
def context_level(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", fx.context_level(F.col("text")).alias("level"))


_ABBR = ", ".join(f"'{a}'" for a in fx.ABBREVIATIONS)


# sentences of (id, t): white space stays as it is inside a sentence
SENTENCES = rf"""w AS (SELECT id, unnest(regexp_extract_all(t, '\s*\S+')) AS raw, unnest(range(len(regexp_extract_all(t, '\s*\S+')))) AS i FROM d),
u AS (SELECT *, regexp_replace(raw, '^\s+', '') AS tok FROM w),
f AS (SELECT *, lower(regexp_replace(tok, '[.?!]$', '')) AS word, lower(coalesce(lag(tok) OVER (PARTITION BY id ORDER BY i), '')) AS prev FROM u),
g AS (SELECT *, CASE WHEN regexp_matches(tok, '[.?!]$') AND NOT (word IN ({_ABBR}) OR regexp_replace(word, '\.$', '') IN ({_ABBR}) OR (i >= 1 AND prev || ' ' || word IN ({_ABBR})))
  AND NOT (regexp_matches(regexp_replace(tok, '[?!]$', ''), '^[0-9]+\.[0-9]*$') OR regexp_matches(tok, '[0-9]+\.[0-9]+')) THEN 1 ELSE 0 END AS closes FROM f),
h AS (SELECT *, coalesce(sum(closes) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM g),
s AS (SELECT id, no::BIGINT AS no, {TRIM.format("string_agg(raw, '' ORDER BY i)")} AS sentence FROM h GROUP BY id, no)"""


@query("sentence_split", f"WITH d AS (SELECT doc_id AS id, text AS t FROM documents), {SENTENCES} SELECT id AS doc_id, no, sentence FROM s")
def sentence_split(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.posexplode(fx.split_sentences(F.col("text"))).alias("no", "sentence")).select("doc_id", long("no").alias("no"), "sentence")


@query("neighbor_context", f"""WITH {LINES}, n AS (SELECT doc_id, pos, line, lag(line) OVER w AS p, lead(line) OVER w AS q FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos::BIGINT AS pos, concat_ws(chr(10) || chr(10), '{context.BEFORE}' || p, '{context.HERE}' || line, '{context.AFTER}' || q) AS context FROM n""")
def neighbor_context(spark, sf):
    return context.neighbours(doc_lines(spark, sf).withColumnRenamed("line", "text")).select("doc_id", long("pos").alias("pos"), "context")


@query("page_stitch", rf"""WITH p AS (SELECT conv_id, turn, string_split(CASE WHEN turn % 2 = 0 THEN regexp_replace(text, '[.?!]+$', '') ELSE lower(substring(text, 1, 1)) || substring(text, 2) END, chr(10)) AS ps FROM conversations),
n AS (SELECT *, CASE WHEN lead(turn) OVER w = turn + 1 THEN lead(ps) OVER w END AS nx, CASE WHEN lag(turn) OVER w = turn - 1 AND turn > 1 THEN lag(ps) OVER w END AS pv FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
a AS (SELECT *, CASE WHEN nx IS NOT NULL AND NOT regexp_matches({TRIM.format('ps[-1]')}, '[.?!]$') THEN list_concat(ps[1:len(ps) - 1], [ps[-1] || ' ' || nx[1]]) ELSE ps END AS e FROM n)
SELECT conv_id, turn, array_to_string(CASE WHEN pv IS NOT NULL AND NOT regexp_matches({TRIM.format('e[1]')}, '^[A-Z]') THEN list_concat([pv[-1] || ' ' || e[1]], e[2:]) ELSE e END, chr(10)) AS page_text FROM a""")
def page_stitch(spark, sf):
    altered = F.when(F.col("turn") % 2 == 0, F.regexp_replace("text", r"[.?!]+\z", "")).otherwise(F.concat(F.lower(F.substring("text", 1, 1)), F.expr("substring(text, 2)")))
    pages = t(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.split(altered, "\n").alias("paragraphs"))
    return context.stitch_pages(pages).select(F.col("doc_id").alias("conv_id"), F.col("page").alias("turn"), F.array_join("paragraphs", "\n").alias("page_text"))


_SEL = "substring(text, 1 + (doc_id * 7) % 90, 12 + (doc_id % 5) * 17)"


@query("selection_context", rf"""WITH {LINES}, s AS (SELECT doc_id, lower({TRIM.format(_SEL)}) AS sel FROM documents),
m AS (SELECT s.doc_id, min(l.pos) AS pos FROM s JOIN lines l ON l.doc_id = s.doc_id AND strpos(lower(l.line), s.sel) > 0 GROUP BY s.doc_id)
SELECT s.doc_id, coalesce(m.pos, -1)::BIGINT AS paragraph, CASE WHEN m.pos IS NULL THEN '' ELSE concat_ws(chr(10) || chr(10), '{context.BEFORE}' || p.line, '{context.HERE}' || h.line, '{context.AFTER}' || n.line) END AS around
FROM s LEFT JOIN m ON m.doc_id = s.doc_id LEFT JOIN lines h ON h.doc_id = m.doc_id AND h.pos = m.pos LEFT JOIN lines p ON p.doc_id = m.doc_id AND p.pos = m.pos - 1 LEFT JOIN lines n ON n.doc_id = m.doc_id AND n.pos = m.pos + 1""")
def selection_context(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id", F.expr("substring(text, cast(1 + (doc_id * 7) % 90 as int), cast(12 + (doc_id % 5) * 17 as int))").alias("selected"), F.split("text", "\n").alias("paragraphs"))
    at = context.first_containing(F.col("paragraphs"), F.col("selected"))
    found = docs.withColumn("at", at)
    return found.select("doc_id", long("at").alias("paragraph"), context.neighbour_text(F.col("paragraphs"), F.col("at")).alias("around"))


_DICT = "SELECT lower(split_part(p_name, ' ', 1)) AS word, p_brand AS phonetic, p_type AS translation, 'n.' AS pos, p_partkey FROM part"


@query("dict_lookup", rf"""WITH d AS (SELECT word, arg_max(translation, p_partkey) AS translation FROM ({_DICT}) GROUP BY word),
w AS (SELECT r_regionkey AS id, r_name AS word FROM region UNION ALL SELECT p_partkey + 100 AS id, CASE WHEN p_partkey % 3 = 0 THEN upper(split_part(p_name, ' ', 1)) WHEN p_partkey % 3 = 1 THEN split_part(p_name, ' ', 1) || ' x' ELSE split_part(p_name, ' ', 1) END AS word FROM part)
SELECT w.id::BIGINT AS id, w.word, CASE WHEN regexp_matches({TRIM.format('w.word')}, '^[A-Za-z]+([''’][A-Za-z]+)*(-[A-Za-z]+)*$') THEN d.translation END AS translation FROM w LEFT JOIN d ON d.word = lower({TRIM.format('w.word')})""")
def dict_lookup(spark, sf):
    part = t(spark, sf, "part")
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    entries = part.select(F.lower(first).alias("word"), F.col("p_brand").alias("phonetic"), F.col("p_type").alias("translation"), F.lit("n.").alias("pos"), "p_partkey")
    entries = entries.groupBy("word").agg(F.max_by(F.struct("phonetic", "translation", "pos"), "p_partkey").alias("e")).select("word", "e.*")
    shown = F.when(F.col("p_partkey") % 3 == 0, F.upper(first)).when(F.col("p_partkey") % 3 == 1, F.concat(first, F.lit(" x"))).otherwise(first)
    words = t(spark, sf, "region").select(long("r_regionkey").alias("id"), F.col("r_name").alias("word")).union(part.select((F.col("p_partkey") + 100).alias("id"), shown.alias("word")))
    return lexicon.look_up(words, entries).select("id", "word", "translation")


_CSVLINE = """split_part(p_name, ' ', 1) || CASE WHEN p_partkey % 7 = 0 THEN ' b' ELSE '' END || ',' || p_brand || ',def,' || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '"' || p_type || ', x"' END || ',n.,' || CASE WHEN p_partkey % 2 = 0 THEN '3' ELSE '' END || ',0,' || CASE WHEN p_partkey % 11 = 0 THEN 'cet4' ELSE '' END || ',0,' || (p_partkey % 3) || ',,,'"""


@query("dict_ingest", """WITH r AS (SELECT p_partkey AS n, lower(split_part(p_name, ' ', 1)) || CASE WHEN p_partkey % 7 = 0 THEN ' b' ELSE '' END AS word, p_brand AS phonetic, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type || ', x' END AS translation FROM part
WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0 OR p_partkey % 11 = 0) SELECT word, arg_max(phonetic, n) AS phonetic, arg_max(translation, n) AS translation FROM r WHERE translation <> '' AND word NOT LIKE '% %' AND regexp_matches(word, '^[a-z]') GROUP BY word""")
def dict_ingest(spark, sf):
    lines = t(spark, sf, "part").select(F.col("p_partkey").alias("line_no"), F.expr(_CSVLINE).alias("value"))
    return lexicon.ingest_dictionary(lines.withColumn("line_no", F.col("line_no") + 1), "light").select("word", "phonetic", "translation")


# a glossary of all distinct words of the benchmark texts, in order
_TERMS = r"""terms AS (SELECT term, row_number() OVER (ORDER BY first, term) - 1 AS ord FROM (SELECT w AS term, min(item_id * 1000 + i) AS first FROM (SELECT item_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i FROM benchmark) WHERE regexp_matches(w, '^[A-Za-z]+$') GROUP BY w))"""


def _terms(spark, sf):
    words = t(spark, sf, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("i", "term")).where(F.col("term").rlike(r"^[A-Za-z]+\z"))
    ranked = words.groupBy("term").agg(F.min(F.col("item_id") * 1000 + F.col("i")).alias("first")).withColumn("ord", F.row_number().over(Window.orderBy("first", "term")) - 1)
    return ranked.select(F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(3)])).alias("library_id"), long("ord").alias("ord"), "term", F.upper("term").alias("translation"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("note"))


@query("glossary_match_tiered", rf"""WITH {_TERMS}, c AS (SELECT conv_id, turn, lower(substring(text, 1, 40)) AS sel, lower(text) AS ctx FROM conversations),
m AS (SELECT conv_id, turn, term, ord, CASE WHEN strpos(sel, lower(term)) > 0 THEN 0 WHEN strpos(ctx, lower(term)) > 0 THEN 1 END AS tier FROM c, terms),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY tier, ord) AS n FROM m WHERE tier IS NOT NULL)
SELECT conv_id, turn, count(*)::BIGINT AS n_terms, string_agg(term, ',' ORDER BY n) AS terms FROM r WHERE n <= 53 GROUP BY conv_id, turn""")
def glossary_match_tiered(spark, sf):
    texts = t(spark, sf, "conversations").select("conv_id", "turn", (F.col("conv_id") % 3).alias("library_id"), F.substring("text", 1, 40).alias("selected"), F.col("text").alias("context"))
    found = lexicon.match_tiered(texts, _terms(spark, sf), keys=("conv_id", "turn")).where(F.size("terms") > 0)
    return found.select("conv_id", "turn", long(F.size("terms")).alias("n_terms"), F.array_join(F.transform("terms", lambda e: e["term"]), ",").alias("terms"))


@query("glossary_match_boundary", rf"""WITH {_TERMS}, w AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM documents), m AS (SELECT w.doc_id, t.term, row_number() OVER (PARTITION BY w.doc_id ORDER BY t.ord) AS n FROM w JOIN terms t ON lower(t.term) = w.w)
SELECT doc_id, string_agg(term, ',' ORDER BY n) AS terms FROM m WHERE n <= 40 GROUP BY doc_id""")
def glossary_match_boundary(spark, sf):
    texts = t(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 3).alias("library_id"), "text")
    return lexicon.match_bounded(texts, _terms(spark, sf), keys=("doc_id",)).where(F.size("terms") > 0).select("doc_id", F.array_join("terms", ",").alias("terms"))


# phrases of two and three words of the benchmark texts (every third line of them with a comma or a hyphen), and single words broken by other characters
_PHRASES = r"""bw AS (SELECT item_id, string_split(text, ' ') AS ws FROM benchmark), ph AS (SELECT item_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM bw),
phrases AS (SELECT row_number() OVER (ORDER BY term) - 1 AS ord, term FROM (SELECT DISTINCT CASE (item_id + i) % 4 WHEN 0 THEN ws[i] || ' ' || ws[i + 1] WHEN 1 THEN ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] WHEN 2 THEN ws[i] || ', ' || ws[i + 1] ELSE '(' || ws[i] || ')-' || ws[i + 1] END AS term FROM ph WHERE (item_id * 7 + i) % 5 = 0))"""
_PLANTED = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR ts IS NULL THEN text ELSE text || chr(10) || CASE doc_id % 3 WHEN 1 THEN array_to_string(ts, '; ') ELSE array_to_string(ts, 'x ') END END AS t FROM documents LEFT JOIN k ON k.k = doc_id % 97"


def _phrase_terms(spark, sf):
    words = t(spark, sf, "benchmark").select("item_id", F.split("text", " ").alias("ws"))
    at = words.select("item_id", "ws", F.explode(F.expr("case when size(ws) > 2 then sequence(1, size(ws) - 2) end")).alias("i"))
    w = lambda k: F.get("ws", F.col("i") - 1 + k)
    kind = (F.col("item_id") + F.col("i")) % 4
    term = F.when(kind == 0, F.concat(w(0), F.lit(" "), w(1))).when(kind == 1, F.concat(w(0), F.lit(" "), w(1), F.lit(" "), w(2))).when(kind == 2, F.concat(w(0), F.lit(", "), w(1))).otherwise(F.concat(F.lit("("), w(0), F.lit(")-"), w(1)))
    terms = at.where((F.col("item_id") * 7 + F.col("i")) % 5 == 0).select(term.alias("term")).distinct()
    return terms.withColumn("ord", long(F.row_number().over(Window.orderBy("term")) - 1))


def _planted(spark, sf, terms):
    """Every text, two thirds of them with phrases behind, which in half of these run into a letter."""
    dealt = terms.groupBy((F.col("ord") % 97).alias("_k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "term"))), lambda x: x["term"]).alias("_terms"))
    docs = t(spark, sf, "documents").withColumn("_k", F.col("doc_id") % 97).join(F.broadcast(dealt), "_k", "left")
    glue = F.when(F.col("doc_id") % 3 == 1, F.array_join("_terms", "; ")).otherwise(F.array_join("_terms", "x "))
    return docs.select("doc_id", F.lit(0).cast("bigint").alias("library_id"), F.when((F.col("doc_id") % 3 == 0) | F.col("_terms").isNull(), F.col("text")).otherwise(F.concat("text", F.lit("\n"), glue)).alias("text"))


@query("glossary_phrases", rf"""WITH {_PHRASES}, k AS (SELECT ord % 97 AS k, list(term ORDER BY ord) AS ts FROM phrases GROUP BY ALL), d AS (SELECT doc_id, lower(t) AS t FROM ({_PLANTED})), h AS (SELECT d.doc_id, p.ord, p.term FROM d JOIN phrases p ON contains(d.t, lower(p.term))
 WHERE regexp_matches(d.t, '(^|[^a-z0-9])' || regexp_escape(lower(p.term)) || '($|[^a-z0-9])')), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM h)
SELECT doc_id, count(*)::BIGINT AS n_terms, string_agg(term, '|' ORDER BY n) AS terms FROM r WHERE n <= 40 GROUP BY doc_id""")
def glossary_phrases(spark, sf):
    terms = _phrase_terms(spark, sf)
    glossary = terms.select(F.lit(0).cast("bigint").alias("library_id"), "ord", "term")
    found = lexicon.match_bounded(_planted(spark, sf, terms), glossary, keys=("doc_id",)).where(F.size("terms") > 0)
    return found.select("doc_id", long(F.size("terms")).alias("n_terms"), F.array_join("terms", "|").alias("terms"))


# pieces of two words and of the insides of words, which the automaton finds where a split into words doesn't
_INSIDE = r"""bw AS (SELECT item_id, string_split(text, ' ') AS ws FROM benchmark), ph AS (SELECT item_id, unnest(range(1, len(ws))) AS i, ws FROM bw),
insides AS (SELECT row_number() OVER (ORDER BY term) - 1 AS ord, term FROM (SELECT DISTINCT CASE (item_id + i) % 2 WHEN 0 THEN substring(ws[i], 2, 3) ELSE substring(ws[i], 3) || ' ' || substring(ws[i + 1], 1, 2) END AS term FROM ph WHERE (item_id * 3 + i) % 4 = 0))"""


@query("glossary_match_inside", rf"""WITH {_INSIDE}, d AS (SELECT doc_id, lower(coalesce(source, '')) AS s, lower(text) AS c FROM documents), h AS (SELECT d.doc_id, p.ord, p.term, CASE WHEN contains(s, lower(p.term)) THEN 0 WHEN contains(c, lower(p.term)) THEN 1 END AS tier FROM d, insides p),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tier, ord) AS n FROM h WHERE tier IS NOT NULL) SELECT doc_id, count(*)::BIGINT AS n_terms, string_agg(term, '|' ORDER BY n) AS terms FROM r WHERE n <= 53 GROUP BY doc_id""")
def glossary_match_inside(spark, sf):
    words = t(spark, sf, "benchmark").select("item_id", F.split("text", " ").alias("ws"))
    at = words.select("item_id", "ws", F.explode(F.expr("case when size(ws) > 1 then sequence(1, size(ws) - 1) end")).alias("i"))
    w = lambda k: F.get("ws", F.col("i") - 1 + k)
    term = F.when((F.col("item_id") + F.col("i")) % 2 == 0, F.substring(w(0), 2, 3)).otherwise(F.concat(F.expr("substring(ws[i - 1], 3)"), F.lit(" "), F.substring(w(1), 1, 2)))
    terms = at.where((F.col("item_id") * 3 + F.col("i")) % 4 == 0).select(term.alias("term")).distinct()
    none = F.lit(None).cast("string")
    glossary = terms.select(F.lit(0).cast("bigint").alias("library_id"), long(F.row_number().over(Window.orderBy("term")) - 1).alias("ord"), "term", none.alias("translation"), none.alias("field"), none.alias("note"))
    texts = t(spark, sf, "documents").select("doc_id", F.lit(0).cast("bigint").alias("library_id"), F.col("source").alias("selected"), F.col("text").alias("context"))
    found = lexicon.match_tiered(texts, glossary, keys=("doc_id",)).where(F.size("terms") > 0)
    return found.select("doc_id", long(F.size("terms")).alias("n_terms"), F.array_join(F.transform("terms", lambda e: e["term"]), "|").alias("terms"))



_ENTRIES = "SELECT p_size % 4 AS library_id, p_partkey AS ord, CASE WHEN p_partkey % 2 = 0 THEN upper(split_part(p_name, ' ', 1)) ELSE split_part(p_name, ' ', 1) END AS term, p_type AS translation, p_brand AS note FROM part"


def _entries(spark, sf):
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    return t(spark, sf, "part").select(long(F.col("p_size") % 4).alias("library_id"), F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 2 == 0, F.upper(first)).otherwise(first).alias("term"), F.col("p_type").alias("translation"), F.col("p_brand").alias("note"))


@query("glossary_merge", f"SELECT library_id::BIGINT AS library_id, min(ord) AS ord, arg_max(term, ord) AS term, arg_max(translation, ord) AS translation, arg_max(note, ord) AS note FROM ({_ENTRIES}) GROUP BY library_id, lower(term)")
def glossary_merge(spark, sf):
    return lexicon.merge_glossary(_entries(spark, sf))


@query("glossary_upsert", f"SELECT library_id::BIGINT AS library_id, min(ord) AS ord, term, arg_max(translation, ord) AS translation, arg_max(note, ord) AS note FROM ({_ENTRIES}) GROUP BY library_id, term")
def glossary_upsert(spark, sf):
    return lexicon.upsert_glossary(_entries(spark, sf))


@query("glossary_first_wins", f"""WITH g AS (SELECT library_id::BIGINT AS library_id, min(ord) AS ord, arg_min(term, ord) AS term, arg_min(translation, ord) AS translation, arg_min(note, ord) AS note FROM ({_ENTRIES}) GROUP BY library_id, lower(term))
SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY library_id ORDER BY ord) <= 40""")
def glossary_first_wins(spark, sf):
    return lexicon.merge_first(_entries(spark, sf))


@query("glossary_csv_roundtrip", "SELECT (p_size % 4)::BIGINT AS library_id, row_number() OVER (PARTITION BY p_size % 4 ORDER BY p_partkey) AS ord, p_name AS term, CASE WHEN p_partkey % 9 = 0 THEN p_type ELSE p_type END AS translation, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS field, CASE WHEN p_partkey % 4 = 0 THEN 'a' END AS note FROM part")
def glossary_csv_roundtrip(spark, sf):
    rows = t(spark, sf, "part").select(long(F.col("p_size") % 4).alias("library_id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("term"), F.col("p_type").alias("translation"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("field"), F.when(F.col("p_partkey") % 4 == 0, "a").alias("note"))
    return lexicon.from_csv(lexicon.to_csv(rows))


# lines altered so that every class occurs
_CLASSED = """CASE pos % 9 WHEN 0 THEN '## ' || line WHEN 1 THEN 'Figure ' || pos || '. ' || line WHEN 2 THEN 'All Rights Reserved ' || line WHEN 3 THEN '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || line || ' | 1 |'
WHEN 4 THEN '$$' || line || '$$' WHEN 5 THEN 'Anna Smith, Bob Jones' WHEN 6 THEN 'College of ' || substring(line, 1, 20) ELSE line END"""


@query("line_classes", rf"""WITH {LINES}, c AS (SELECT doc_id, pos, {_CLASSED} AS line FROM lines), f AS (SELECT *, {TRIM.format('line')} AS s, list_filter(string_split(line, chr(10)), lambda x: x <> '') AS ls, regexp_split_to_array(line, '\s+') AS ws FROM c)
SELECT doc_id, pos::BIGINT AS pos, regexp_matches(s, '(?i)^({"|".join(fx.DROP_STARTS)})') AS dropped, regexp_matches(s, '(?i)^(fig(ure)?\.?|table)\s+[0-9]+[.:\s]') AS caption,
 coalesce(len(ls) >= 2 AND contains(ls[1], '|') AND contains(ls[2], '|') AND regexp_matches(ls[2], '^\s*\|?\s*:?-{{3,}}'), false) AS md_table, length(s) > 4 AND regexp_matches(s, '(?s)^(\$\$.*\$\$|\\\[.*\\\])$') AS formula,
 length(line) <= 240 AND NOT regexp_matches(line, '[.!?]\s*$') AND (regexp_matches(line, '(?i)\b({"|".join(fx.INSTITUTIONS)})\b') OR (len(ws) BETWEEN 2 AND 20 AND len(list_filter(ws, lambda w: regexp_matches(w, '^[A-Z][A-Za-z''’-]+,?$'))) >= ceil(len(ws) / 2))) AS author FROM f""")
def line_classes(spark, sf):
    rows = doc_lines(spark, sf).withColumn("line", F.expr(_CLASSED.replace("chr(10)", "char(10)")))
    c = F.col("line")
    return rows.select("doc_id", long("pos").alias("pos"), fx.is_dropped_line(c).alias("dropped"), fx.is_caption_line(c).alias("caption"), fx.is_markdown_table(c).alias("md_table"), fx.is_formula(c).alias("formula"), fx.is_author_line(c).alias("author"))


@query("structure_blocks")
def structure_blocks(spark, sf):
    """Documents as markdown: a title, then each line a segment, the last under references; rows only (a sequential machine)."""
    body = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 7 == 3, F.concat(F.lit("## "), F.substring(x, 1, 30))).when(i % 11 == 5, F.concat(F.lit("![fig](img/a.png) "), x)).otherwise(x)), "\n\n")
    parsed = t(spark, sf, "documents").select("doc_id", F.concat(F.lit("# Paper "), F.col("doc_id").cast("string"), F.lit("\n\n"), body, F.lit("\n\n## References\n\nSmith, A. One.\nJones, B. Two.")).alias("markdown"), F.array(F.struct(F.lit("x/img/a.png").alias("original_path"), F.lit("assets/0001-a.png").alias("relative_path"))).alias("assets"))
    return structure.structure_documents(parsed)


# paragraphs broken at commas, as pages break sentences
_BROKEN = "b AS (SELECT doc_id, unnest(string_split(replace(text, ', ', ',' || chr(10)), chr(10))) AS source, unnest(range(len(string_split(replace(text, ', ', ',' || chr(10)), chr(10))))) AS pos FROM documents)"
_LOWER = "regexp_matches(" + TRIM.format("{}") + r", '^[\"“‘''(\[]*[a-zà-öø-ÿ]')"
_OPEN = "(" + TRIM.format("{0}") + " <> '' AND NOT regexp_matches(" + TRIM.format("{0}") + r", '[.!?][\"”’'')\]]*$'))"


def _broken(spark, sf, floats: bool = False):
    rows = t(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.replace("text", F.lit(", "), F.lit(",\n")), "\n")).alias("pos", "source"))
    kind = F.when(F.col("pos") % 6 == 2, "table").when(F.col("pos") % 6 == 3, "caption").otherwise("paragraph") if floats else F.lit("paragraph")
    return rows.select("doc_id", "pos", F.format_string("b%04d", F.col("pos") + 1).alias("id"), kind.alias("type"), "source")


@query("continuation_pairs", f"""WITH {_BROKEN}, n AS (SELECT doc_id, pos, source, lead(source) OVER (PARTITION BY doc_id ORDER BY pos) AS nx FROM b)
SELECT doc_id, printf('b%04d', pos + 1) AS id, printf('b%04d', pos + 2) AS next_id FROM n WHERE {_OPEN.format('source')} AND nx IS NOT NULL AND {_LOWER.format('nx')}""")
def continuation_pairs(spark, sf):
    return structure.continuation_pairs(_broken(spark, sf)).select("doc_id", "id", "next_id")


_LEADS = ", ".join(f"lead(pos, {i}) OVER w AS p{i}, lead(st, {i}) OVER w AS s{i}, lead(fl, {i}) OVER w AS f{i}, lead(ok, {i}) OVER w AS o{i}" for i in range(1, 6))
_REACHED = "CASE " + " ".join(f"WHEN s{i} THEN " + (f"p{i}" if i == 1 else "CASE WHEN (" + " OR ".join(f"f{j}" for j in range(1, i)) + ") AND " + " AND ".join(f"o{j}" for j in range(1, i)) + f" THEN p{i} END") for i in range(1, 6)) + " END"


@query("continuation_float", f"""WITH {_BROKEN}, k AS (SELECT *, CASE WHEN pos % 6 = 2 THEN 'table' WHEN pos % 6 = 3 THEN 'caption' ELSE 'paragraph' END AS type FROM b),
x AS (SELECT *, type = 'paragraph' AND {_LOWER.format('source')} AS st, type = 'table' AS fl, type IN ('table', 'caption') OR length(source) <= 260 AS ok FROM k), n AS (SELECT *, {_LEADS} FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos, {_REACHED} AS target FROM n WHERE type = 'paragraph' AND {_OPEN.format('source')})
SELECT doc_id, printf('b%04d', pos + 1) AS id, printf('b%04d', target + 1) AS next_id, target = pos + 1 AS adjacent FROM r WHERE target IS NOT NULL""")
def continuation_float(spark, sf):
    return structure.continuation_pairs(_broken(spark, sf, floats=True))


@query("merge_chains", f"""WITH {_BROKEN}, m AS (SELECT *, CASE WHEN {_LOWER.format('source')} AND coalesce({_OPEN.format('lag(source) OVER w')}, false) THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM m) SELECT doc_id, min(pos)::BIGINT AS first_pos, count(*)::BIGINT AS n, md5(string_agg({TRIM.format('source')}, ' ' ORDER BY pos)) AS source_md5 FROM r GROUP BY doc_id, run""")
def merge_chains(spark, sf):
    return structure.merge_chains(_broken(spark, sf)).select("doc_id", long("first_pos").alias("first_pos"), "n", F.md5("source").alias("source_md5"))


@query("reindex_blocks", f"WITH {LINES} SELECT doc_id, pos::BIGINT AS pos, printf('b%04d', row_number() OVER (PARTITION BY doc_id ORDER BY pos)) AS id FROM lines WHERE {TRIM.format('line')} <> ''")
def reindex_blocks(spark, sf):
    return structure.reindex(doc_lines(spark, sf).where(fx.js_trim(F.col("line")) != "")).select("doc_id", long("pos").alias("pos"), "id")


# every kind of span, some of them nested, around the page
_SPANNED = """html || ' see https://a.example/x?y=1 and $x^2$ or `code` (Smith, 2019) doi 10.1000/xyz' || page_id || ' by Jones (2020) ' || chr(36) || chr(36) || 'a' || chr(36) || chr(36) || ' end'"""


def _pass_sql(kind: str, pattern: str, at: int, flags: str = "") -> str:
    """One pass in SQL: what matches becomes its token, numbered on; ``v`` lists (token, value) in order of creation."""
    found = f"regexp_extract_all(x, '{pattern}', 0{flags})"
    parts = f"string_split(regexp_replace(x, '{pattern}', chr(1), 'g{flags[3:4]}'), chr(1))"
    return f"""p{at} AS (SELECT page_id, v, len(v) AS n, {found} AS m, {parts} AS ps FROM p{at - 1}x), p{at}x AS (SELECT page_id, list_concat(v, list_transform(m, lambda y, i: ['⟦{kind}_' || (n + i - 1) || '⟧', y])) AS v,
    array_to_string(list_transform(ps, lambda y, i: y || CASE WHEN i < len(ps) THEN '⟦{kind}_' || (n + i - 1) || '⟧' ELSE '' END), '') AS x FROM p{at})"""


_AUTHOR_SQL = fx.AUTHOR.replace("'", "''")
_CITED = rf"\b{_AUTHOR_SQL}(?:\s+et al\.|\s+(?:and|&)\s+{_AUTHOR_SQL}|(?:,\s+{_AUTHOR_SQL}){{1,3}}(?:,?\s+(?:and|&)\s+{_AUTHOR_SQL})?)?\s*\({fx.YEAR}(?:,\s*(?:pp?\.\s*)?[0-9–—-]+)?\)"
_SPAN_PASSES = (
    ("CODE", r"```[\s\S]*?```|`[^`\n]+`", ""), ("CODE", r"</?[A-Za-z][^>]*>", ""), ("MATH", r"\$\$[\s\S]*?\$\$|\$[^$\n]+\$|\\\[[\s\S]*?\\\]", ""), ("URL", r"https?://[^\s)>\]]+", ""),
    ("DOI", r"\b10\.[0-9]{4,9}/[-._;()/:A-Z0-9]+\b", ", 'i'"), ("CIT", _CITED, ""), ("CIT", r"\([^()\n]{0,160}\b(?:18|19|20)[0-9]{2}[a-z]?(?:[^()\n]{0,160})\)", ", 'i'"),
)
_PROTECTED = f"WITH p0x AS (SELECT page_id, []::VARCHAR[][] AS v, {_SPANNED} AS x FROM pages), " + ", ".join(_pass_sql(k, p, i, f) for i, (k, p, f) in enumerate(_SPAN_PASSES, 1))


def _spanned(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.expr(_SPANNED.replace("chr(", "char(")).alias("source"))


_COUNTED = ", ".join(f"len(list_filter(v, lambda y: starts_with(y[1], '⟦{k}_')))::BIGINT AS {k.lower()}" for k in ("CODE", "MATH", "URL", "DOI", "CIT"))


@query("protect_counts", f"{_PROTECTED} SELECT page_id, {_COUNTED} FROM p7x")
def protect_counts(spark, sf):
    n = protocol.span_counts(F.col("source"))
    return _spanned(spark, sf).select("page_id", *[long(c).alias(k.lower()) for k, c in n.items()])


@query("protect_spans", f"{_PROTECTED} SELECT page_id, x AS protected, array_to_string(list_transform(v, lambda y: y[1] || '=' || y[2]), chr(10)) AS spans FROM p7x")
def protect_spans(spark, sf):
    rows = protocol.protect_texts(_spanned(spark, sf))
    return rows.select("page_id", "protected", F.array_join(F.transform("spans", lambda x: F.concat(x["token"], F.lit("="), x["value"])), "\n").alias("spans"))


@query("protect_restore", f"""{_PROTECTED}, n AS (SELECT q.page_id, list_filter(v, lambda y: NOT contains(CASE WHEN q.page_id % 6 = 3 THEN replace(x, '⟦URL_', '⟦GONE_') ELSE x END, y[1])) AS missing FROM p7x q), w AS (SELECT page_id AS no, {TRIM.format(_SPANNED)} AS whole FROM pages)
SELECT n.page_id, CASE WHEN n.page_id % 2 = 0 OR len(missing) = 0 THEN w.whole END AS restored, CASE WHEN n.page_id % 2 = 1 THEN missing[1][1] END AS lost FROM n JOIN w ON w.no = n.page_id""")
def protect_restore(spark, sf):
    """Even pages restore nested spans too; odd ones, every third of which lost its links, name the first lost token."""
    rows = protocol.protect_texts(_spanned(spark, sf))
    back = F.when(F.col("page_id") % 6 == 3, F.replace("protected", F.lit("⟦URL_"), F.lit("⟦GONE_"))).otherwise(F.col("protected"))
    rows = rows.withColumn("answer", back)
    done = F.when(F.col("page_id") % 2 == 0, protocol.restore(F.col("answer"), F.col("spans"), nested=True)).otherwise(protocol.restore(F.col("answer"), F.col("spans")))
    return rows.withColumn("r", done).select("page_id", F.col("r.text").alias("restored"), F.col("r.lost").alias("lost"))


@query("id_protocol_parse", f"""WITH {LINES} SELECT doc_id, printf('b%04d', pos + 1) AS id, {TRIM.format('line')} AS translation FROM lines WHERE {TRIM.format('line')} <> ''""")
def id_protocol_parse(spark, sf):
    body = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit(" @@b"), F.lpad((i + 1).cast("string"), 4, "0"), F.lit(" \n"), x)), "\n\n")
    out = t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("request_id"), F.concat(F.lit("Sure:\r\n"), body).alias("output"))
    return protocol.parse_ids(out).select(long("request_id").alias("doc_id"), "id", "translation")


@query("json_protocol_parse", f"SELECT item_id, 'b' || item_id AS id, {TRIM.format('text')} AS translation FROM benchmark")
def json_protocol_parse(spark, sf):
    rows = t(spark, sf, "benchmark").select("item_id", F.create_map(F.concat(F.lit("b"), F.col("item_id").cast("string")), F.concat(F.lit(" "), "text"), F.lit("blank"), F.lit(" ")).alias("m"))
    body = F.concat(F.lit("```json\n{\"translations\": "), F.concat(F.regexp_replace(F.to_json("m"), r"\}\z", ""), F.lit(", \"n\": 5}")), F.lit("}\n```"))
    return protocol.parse_json(rows.select(F.col("item_id").alias("request_id"), body.alias("output"))).select(F.col("request_id").alias("item_id"), "id", "translation")


@query("sanitize_repair", f"WITH {LINES} SELECT doc_id, pos::BIGINT AS pos, {TRIM.format('line')} AS translation, (pos % 3 <> 2) OR {TRIM.format('line')} <> line AS changed FROM lines WHERE {TRIM.format('line')} <> ''")
def sanitize_repair(spark, sf):
    rows = doc_lines(spark, sf).where(fx.js_trim(F.col("line")) != "").withColumn("translation", F.expr("case pos % 3 when 0 then '[TYPE=paragraph] ' when 1 then '**TYPE: heading**\\n\\n' else '' end || line"))
    return protocol.repair_translations(rows).select("doc_id", long("pos").alias("pos"), "translation", "changed")


# blocks of all lines: labels decide the translation state, doc_id does where there is none
_BLOCKS = """blocks AS (SELECT l.doc_id, l.pos, 'b' || (l.pos % 5) AS id, CASE WHEN l.pos % 4 = 3 THEN 'image' ELSE 'paragraph' END AS type, CASE WHEN l.pos % 6 = 5 THEN ' ' ELSE l.line END AS source,
CASE WHEN l.q = 1 AND l.pos % 3 = 0 THEN 'x ⟦CIT_3⟧ ' || l.line WHEN l.q = 1 THEN l.line WHEN l.pos % 3 = 1 THEN '@@b7' END AS translation
FROM (SELECT n.doc_id, n.pos, n.line, CASE WHEN b.doc_id IS NULL THEN n.doc_id % 2 ELSE b.quality END AS q FROM lines n LEFT JOIN labels b ON b.doc_id = n.doc_id) l)"""
_ISSUES = f"""{_BLOCKS}, d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY pos) AS rn FROM blocks),
i AS (SELECT doc_id, pos, 0 AS rule, id, 'duplicate-id' AS code FROM d WHERE rn > 1 UNION ALL SELECT doc_id, pos, 1, id, 'missing-source' FROM d WHERE type <> 'image' AND trim(source) = ''
UNION ALL SELECT doc_id, pos, 2, id, 'missing-translation' FROM d WHERE type = 'paragraph' AND trim(coalesce(translation, '')) = '' UNION ALL SELECT doc_id, pos, 3, id, 'unresolved-placeholder' FROM d WHERE contains(translation, '⟦CIT_3⟧')
UNION ALL SELECT doc_id, pos, 4, id, 'protocol-leak' FROM d WHERE translation = '@@b7' UNION ALL SELECT doc_id, pos, 6, id, 'missing-asset' FROM d WHERE type = 'image'),
o AS (SELECT doc_id, id AS block_id, code, row_number() OVER (PARTITION BY doc_id ORDER BY pos, rule) AS ord FROM i)"""


def _state_blocks(spark, sf):
    labels = t(spark, sf, "labels").select("doc_id", "quality", F.lit(True).alias("labelled"))
    rows = doc_lines(spark, sf).join(labels, "doc_id", "left").withColumn("quality", F.when(F.col("labelled"), F.col("quality")).otherwise(F.col("doc_id") % 2))
    e = F.expr
    return rows.select(
        "doc_id", "pos", e("'b' || (pos % 5)").alias("id"), e("case when pos % 4 = 3 then 'image' else 'paragraph' end").alias("type"), e("case when pos % 6 = 5 then ' ' else line end").alias("source"),
        e("case when quality = 1 and pos % 3 = 0 then 'x ⟦CIT_3⟧ ' || line when quality = 1 then line when pos % 3 = 1 then '@@b7' end").alias("translation"), F.lit(None).cast("string").alias("asset_path"),
    )


@query("validate_issues", f"WITH {LINES}, {_ISSUES} SELECT doc_id, ord::BIGINT AS ord, block_id, code FROM o")
def validate_issues(spark, sf):
    return validate.issues(_state_blocks(spark, sf), boundaries=False).select("doc_id", long("ord").alias("ord"), "block_id", "code")


@query("validate_rollup", f"WITH {LINES}, {_ISSUES} SELECT d.doc_id, count(o.code) = 0 AS valid, count(o.code)::BIGINT AS n_issues FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN o ON o.doc_id = d.doc_id GROUP BY d.doc_id")
def validate_rollup(spark, sf):
    found = validate.issues(_state_blocks(spark, sf), boundaries=False)
    return validate.rollup(t(spark, sf, "documents").select("doc_id").distinct(), found).select("doc_id", "valid", "n_issues")


_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query("html_escape", f"SELECT page_id, {_ESC.format('html')} AS escaped FROM pages")
def html_escape(spark, sf):
    return t(spark, sf, "pages").select("page_id", fx.escape_html(F.col("html")).alias("escaped"))


@query("inline_markdown", rf"""WITH {LINES}, m AS (SELECT doc_id, pos, regexp_replace(line, '[*$_`]', '', 'g') AS e FROM lines)
SELECT doc_id, pos::BIGINT AS pos, '<strong>' || {_ESC.format('substring(e, 1, 3)')} || 'x</strong> <code>c</code> <sup>2</sup><strong>u</strong> <em>v</em> ' || {_ESC.format('e')} AS html FROM m""")
def inline_markdown(spark, sf):
    rows = doc_lines(spark, sf).withColumn("l", F.regexp_replace("line", r"[*$_`]", ""))
    marked = F.concat(F.lit("**"), F.substring("l", 1, 3), F.lit("x** `c` $^{2}$__u__ *v* "), "l")
    return rows.select("doc_id", long("pos").alias("pos"), fx.inline_markdown(marked).alias("html"))


@query("table_render", r"""SELECT p_partkey, '<div class="table-wrap"><table><thead><tr><th>name</th><th>size</th></tr></thead><tbody><tr><td>' || p_name || '</td><td>' || p_size || '</td></tr><tr><td>a|b</td><td><em>' || p_brand || '</em></td></tr></tbody></table></div>' AS html FROM part""")
def table_render(spark, sf):
    md = F.expr(r"'| name | size |\n|---|---|\n| ' || p_name || ' | ' || p_size || ' |\n\n| a\\|b | *' || p_brand || '* |'")
    return t(spark, sf, "part").select("p_partkey", render.markdown_table(md).alias("html"))


_KINDS = "CASE WHEN pos = 0 THEN 'title' WHEN pos % 5 = 1 THEN 'heading' WHEN pos % 5 = 2 THEN 'drop' WHEN pos % 5 = 3 THEN 'reference' ELSE 'paragraph' END"


@query("render_body", rf"""WITH {LINES}, k AS (SELECT doc_id, pos, printf('b%04d', pos + 1) AS id, {_KINDS} AS type, {_ESC.format("regexp_replace(line, '[*$_`]', '', 'g')")} AS s FROM lines),
h AS (SELECT doc_id, pos, CASE type WHEN 'title' THEN '<h1 class="bilingual-block" data-block-id="' || id || '"><span class="en">' || s || '</span><span class="zh">' || upper_t || '</span></h1>'
 WHEN 'heading' THEN '<h2 class="bilingual-block" data-block-id="' || id || '"><span class="en">' || s || '</span><span class="zh">' || upper_t || '</span></h2>'
 WHEN 'reference' THEN '<p class="reference en-always" data-block-id="' || id || '">' || s || '</p>'
 WHEN 'paragraph' THEN '<section class="pair" data-block-id="' || id || '"><p class="en">' || s || '</p><p class="zh">' || upper_t || '</p></section>' END AS html FROM (SELECT *, 't' || pos AS upper_t FROM k))
SELECT doc_id, md5(string_agg(html, chr(10) ORDER BY pos)) AS body_md5 FROM h WHERE html IS NOT NULL GROUP BY doc_id""")
def render_body(spark, sf):
    rows = doc_lines(spark, sf).select("doc_id", "pos", F.format_string("b%04d", F.col("pos") + 1).alias("id"), F.expr(_KINDS).alias("type"), F.regexp_replace("line", r"[*$_`]", "").alias("source"), F.expr("'[TYPE=heading] t' || pos").alias("translation"))
    return render.render_bodies(rows, tables=False).select("doc_id", F.md5("body").alias("body_md5"))


@query("asset_match", r"""WITH i AS (SELECT page_id, regexp_extract(url, '[^/]*$') AS src FROM pages), a AS (SELECT page_id AS ord, 'p' || page_id AS rel, CASE WHEN page_id % 3 = 0 THEN regexp_extract(url, '[^/]*$') ELSE replace(url, '/', '\') END AS orig FROM pages),
m AS (SELECT i.page_id, a.rel, row_number() OVER (PARTITION BY i.page_id ORDER BY a.ord) AS n FROM i JOIN a ON replace(a.orig, '\', '/') = i.src OR ends_with(replace(a.orig, '\', '/'), '/' || i.src))
SELECT i.page_id, i.src, m.rel AS relative_path FROM i LEFT JOIN m ON m.page_id = i.page_id AND m.n = 1""")
def asset_match(spark, sf):
    last = F.regexp_extract("url", r"[^/]*\z", 0)
    pages = t(spark, sf, "pages")
    images = pages.select(F.lit(1).alias("doc_id"), "page_id", last.alias("src"))
    assets = pages.select(F.lit(1).alias("doc_id"), F.col("page_id").alias("ord"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("relative_path"), F.when(F.col("page_id") % 3 == 0, last).otherwise(F.replace("url", F.lit("/"), F.lit("\\"))).alias("original_path"))
    return history.match_assets(images, assets).select("page_id", "src", "relative_path")


def _history(spark, sf):
    c = t(spark, sf, "conversations")
    return c.select(
        long(F.col("conv_id") % 7).alias("library_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), (F.col("conv_id") * 100 + F.col("turn")).alias("ord"), F.substring("text", 1, 30).alias("selected"), F.col("text").alias("context"),
        F.lit(None).cast("string").alias("result"), F.lit(None).cast("string").alias("item_title"), F.expr("'lib' || (conv_id % 7)").alias("library_name"), F.col("role").alias("operation"),
        F.lit(None).cast("string").alias("phonetic"), F.lit("").alias("translation"), (F.col("conv_id") % 5).alias("item_id"), ((F.col("conv_id") * 7919 + F.col("turn") * 31) % 100000).alias("ts_ms"),
    )


@query("history_search", "SELECT conv_id * 100 + turn AS id FROM conversations WHERE strpos(lower(substring(text, 1, 30) || chr(10) || text || chr(10) || chr(10) || chr(10) || 'lib' || (conv_id % 7) || chr(10) || coalesce(role, '') || chr(10) || chr(10)), 'us') > 0")
def history_search(spark, sf):
    return history.search(_history(spark, sf), " US ").select("id")


_SEARCH = "CASE item_id % 6 WHEN 0 THEN substring(text, 3, 2) WHEN 1 THEN ' ' || upper(substring(text, 1, 3)) || ' ' WHEN 2 THEN substring(text, 5, 5) WHEN 3 THEN 'lib' || (item_id % 9) WHEN 4 THEN substring(text, 2, 1) ELSE substring(text, 1, 30) END AS query"


@query("history_search_many", rf"""WITH q AS (SELECT query_id, lower({TRIM.format('query')}) AS q FROM (SELECT item_id AS query_id, {_SEARCH} FROM benchmark)), h AS (SELECT conv_id * 100 + turn AS id, lower(substring(text, 1, 30) || chr(10) || text || chr(10) || chr(10) || chr(10) || 'lib' || (conv_id % 7) || chr(10) || coalesce(role, '') || chr(10) || chr(10)) AS x FROM conversations)
SELECT q.query_id, h.id FROM q JOIN h ON contains(h.x, q.q)""")
def history_search_many(spark, sf):
    searches = t(spark, sf, "benchmark").selectExpr("item_id AS query_id", _SEARCH)
    return history.search_many(searches, _history(spark, sf))


@query("history_by_item", "SELECT conv_id * 100 + turn AS id FROM conversations WHERE conv_id % 5 = 3")
def history_by_item(spark, sf):
    return history.by_item(_history(spark, sf), 3).select("id")


@query("history_top", "SELECT (conv_id % 7)::BIGINT AS library_id, conv_id * 100 + turn AS id, row_number() OVER (PARTITION BY conv_id % 7 ORDER BY conv_id * 100 + turn DESC) AS rank FROM conversations QUALIFY rank <= 20")
def history_top(spark, sf):
    return history.newest(_history(spark, sf), 20).select("library_id", "id", long("rank").alias("rank"))


@query("history_delete", "SELECT (conv_id % 7)::BIGINT AS library_id, conv_id * 100 + turn AS id FROM conversations WHERE NOT (turn % 2 = 1 AND role = 'user')")
def history_delete(spark, sf):
    h = _history(spark, sf)
    return history.delete(h, h.where("ord % 100 % 2 = 1 and operation = 'user'")).select("library_id", "id")


@query("history_titles_missed", "SELECT c.c_custkey AS id, CASE WHEN c.c_custkey % 3 = 0 THEN 'unknown' ELSE n.n_name END AS item_title FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey")
def history_titles_missed(spark, sf):
    """A third of the records name an item that is gone, another third one whose parent is."""
    gone = F.when(F.col("n_nationkey") % 2 == 0, F.lit(-1))
    items = t(spark, sf, "nation").select(F.col("n_nationkey").alias("item_id"), gone.cast("int").alias("parent_id"), F.col("n_name").alias("title"))
    rows = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey") + 500).otherwise(F.col("c_nationkey")).alias("item_id"))
    return history.item_titles(rows, items, "unknown").select("id", "item_title")


@query("history_cap", "SELECT event_id AS id, (user_id % 3)::BIGINT AS library_id, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id DESC)::BIGINT AS place FROM events QUALIFY place <= 1000")
def history_cap(spark, sf):
    """Three libraries of thousands of records, each cut to the last thousand."""
    rows = t(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_id").alias("ord"), long(F.col("user_id") % 3).alias("library_id"))
    return history.newest(rows).select("id", "library_id", long("rank").alias("place"))


@query("history_titles", "SELECT c.c_custkey AS id, CASE WHEN n.n_nationkey % 4 = 1 THEN (CASE WHEN n.n_nationkey % 3 = 0 THEN '?' ELSE n.n_name END) ELSE r.r_name END AS item_title FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey")
def history_titles(spark, sf):
    n, r = t(spark, sf, "nation"), t(spark, sf, "region")
    items = n.select(F.col("n_nationkey").alias("item_id"), F.when(F.col("n_nationkey") % 4 != 1, F.col("n_regionkey") + 1000).alias("parent_id"), F.when(F.col("n_nationkey") % 3 == 0, " ").otherwise(F.col("n_name")).alias("title"))
    items = items.union(r.select(F.col("r_regionkey") + 1000, F.lit(None).cast("int"), "r_name"))
    rows = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("item_id"))
    return history.item_titles(rows, items).select("id", "item_title")


# events as jobs: a user is a job, an event type stands for a stage
_STAGE = "CASE event_type WHEN 'click' THEN 'translating' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'queued' ELSE 'rendering' END"
_LAST = "CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'validating' WHEN event_id % 4 = 2 THEN 'structuring' ELSE 'unknown' END"
_JOBS = f"jobs AS (SELECT event_id AS id, {_STAGE} AS stage, {_LAST} AS last, event_id % 17 AS done, event_id % 12 AS total FROM events)"


def _jobs(spark, sf):
    return t(spark, sf, "events").select(F.col("event_id").alias("id"), F.expr(_STAGE).alias("stage"), F.expr(_LAST).alias("last"), (F.col("event_id") % 17).alias("done"), (F.col("event_id") % 12).alias("total"), "user_id", "ts")


_STAGE_LIST = ", ".join(f"'{s}'" for s in jobs.STAGES)


@query("job_progress", f"""WITH {_JOBS}, e AS (SELECT *, CASE WHEN stage IN ('paused', 'failed', 'cancelled', 'queued') AND last IS NOT NULL THEN last ELSE stage END AS eff FROM jobs), p AS (SELECT *, list_position([{_STAGE_LIST}], eff) AS place FROM e)
SELECT id, eff AS effective, round(CASE WHEN stage = 'completed' THEN 100.0 WHEN coalesce(place, 0) = 0 THEN 0.0 ELSE least(99.0, ((place - 1) + CASE WHEN total > 0 THEN least(1.0, greatest(0.0, done / total)) ELSE 0.0 END) / 8 * 100) END::DOUBLE, 6) AS percent FROM p""")
def job_progress(spark, sf):
    j = _jobs(spark, sf)
    return j.select("id", jobs.effective_stage(F.col("stage"), F.col("last")).alias("effective"), F.round(jobs.progress_percent(F.col("stage"), F.col("last"), F.col("done"), F.col("total")), 6).alias("percent"))


@query("job_filter", f"WITH {_JOBS} SELECT id, CASE WHEN stage = 'completed' THEN 'completed' WHEN stage IN ('failed', 'cancelled') THEN 'failed' ELSE 'active' END AS class FROM jobs")
def job_filter(spark, sf):
    j = _jobs(spark, sf)
    out = [j.where(jobs.in_class(F.col("stage"), c)).select("id", F.lit(c).alias("class")) for c in ("active", "completed", "failed")]
    return out[0].union(out[1]).union(out[2])


@query("job_summary", f"WITH {_JOBS} SELECT count(*) FILTER (WHERE stage IN ('translating', 'queued', 'rendering'))::BIGINT AS active_jobs, count(*) FILTER (WHERE stage = 'completed')::BIGINT AS completed_jobs, (SELECT count(*) FROM conversations)::BIGINT AS history FROM jobs")
def job_summary(spark, sf):
    return jobs.summary(_jobs(spark, sf), t(spark, sf, "conversations"))


@query("job_events_ring", "SELECT user_id AS job_id, event_id AS ord, 'key <redacted-api-key> ' || event_type AS message FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 80")
def job_events_ring(spark, sf):
    rows = t(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("ord"), F.expr("'key sk-' || lpad(cast(event_id as string), 12, 'a') || ' ' || event_type").alias("message"))
    return jobs.event_ring(rows)


@query("progress_throttle", """WITH RECURSIVE e AS (SELECT user_id AS job_id, event_id AS ord, epoch_us(ts) // 1000 AS at_ms, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
r AS (SELECT job_id, ord, rn, at_ms AS last, true AS kept FROM e WHERE rn = 1 UNION ALL SELECT e.job_id, e.ord, e.rn, CASE WHEN e.at_ms - r.last >= 86400000 THEN e.at_ms ELSE r.last END, e.at_ms - r.last >= 86400000 FROM r JOIN e ON e.job_id = r.job_id AND e.rn = r.rn + 1)
SELECT job_id, ord FROM r WHERE kept""")
def progress_throttle(spark, sf):
    rows = t(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("ord"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return jobs.throttled(rows, 86_400_000).select("job_id", "ord")


@query("usage_rollup", "SELECT user_id AS job_id, sum(event_id % 100)::BIGINT AS prompt, coalesce(sum(CASE WHEN event_id % 3 > 0 THEN event_id % 50 END), 0)::BIGINT AS completion, sum(event_id % 150)::BIGINT AS total, count(*)::BIGINT AS requests FROM events GROUP BY user_id")
def usage_rollup(spark, sf):
    rows = t(spark, sf, "events").select(F.col("user_id").alias("job_id"), (F.col("event_id") % 100).alias("prompt"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 50).alias("completion"), (F.col("event_id") % 150).alias("total"))
    return jobs.usage(rows)


@query("job_reuse", """WITH j AS (SELECT o_orderkey AS id, o_custkey % 50 AS attachment_id, o_orderstatus AS fingerprint, CASE o_orderkey % 4 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'completed' WHEN 2 THEN 'paused' ELSE 'translating' END AS stage, o_orderkey % 3 = 0 AS out, epoch_ms(o_orderdate) AS upd FROM orders),
b AS (SELECT * FROM j WHERE stage <> 'cancelled' QUALIFY row_number() OVER (PARTITION BY attachment_id, fingerprint ORDER BY upd DESC, id) = 1), q AS (SELECT c_custkey AS request_id, c_custkey % 60 AS attachment_id, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'O' END AS fingerprint FROM customer)
SELECT q.request_id, b.id AS job_id, CASE WHEN b.id IS NULL THEN 'create' WHEN b.stage <> 'completed' THEN 'resume' WHEN b.out THEN 'return' ELSE 'requeue' END AS action FROM q LEFT JOIN b ON b.attachment_id = q.attachment_id AND b.fingerprint = q.fingerprint""")
def job_reuse(spark, sf):
    j = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("attachment_id"), F.col("o_orderstatus").alias("fingerprint"), F.expr("case o_orderkey % 4 when 0 then 'cancelled' when 1 then 'completed' when 2 then 'paused' else 'translating' end").alias("stage"), (F.col("o_orderkey") % 3 == 0).alias("output_exists"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("updated_ms"))
    q = t(spark, sf, "customer").select(F.col("c_custkey").alias("request_id"), (F.col("c_custkey") % 60).alias("attachment_id"), F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("O").alias("fingerprint"))
    return jobs.reusable(q, j).select("request_id", "job_id", "action")


@query("job_recovery", f"""WITH {_JOBS}, s AS (SELECT id, stage, last, id % 5 = 0 AS live, id % 6 AS blocks, id % 4 AS done2 FROM jobs), x AS (SELECT *, stage IN ('translating', 'queued', 'rendering') AND NOT live AS stopped FROM s)
SELECT id, CASE WHEN stopped THEN 'paused' ELSE stage END AS stage, CASE WHEN stopped THEN coalesce(last, CASE WHEN stage <> 'queued' THEN stage END, CASE WHEN blocks = 0 THEN 'extracting' WHEN done2 < blocks THEN 'translating' ELSE 'validating' END) ELSE last END AS last_active_stage FROM x""")
def job_recovery(spark, sf):
    j = _jobs(spark, sf).select("id", "stage", F.col("last").alias("last_active_stage"))
    docs = j.select("id", (F.col("id") % 6).alias("blocks"), (F.col("id") % 4).alias("translated"))
    return jobs.recover(j, j.where("id % 5 = 0").select("id"), docs)


@query("cache_latest", """WITH w AS (SELECT user_id AS item_id, event_id % 7 AS page, event_type AS action, event_id AS ord, CASE WHEN event_id % 10 = 0 THEN 0 ELSE epoch_us(ts) // 1000 END AS ts_ms, round(value, 4) AS llm_result FROM events),
l AS (SELECT item_id, page, action, arg_max(ts_ms, ord) AS ts_ms, arg_max(llm_result, ord) AS llm_result FROM w GROUP BY ALL) SELECT * FROM l WHERE ts_ms > 0""")
def cache_latest(spark, sf):
    w = t(spark, sf, "events").select(F.col("user_id").alias("item_id"), (F.col("event_id") % 7).alias("page"), F.col("event_type").alias("action"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 10 == 0, 0).otherwise(F.unix_millis(F.col("ts").cast("timestamp"))).alias("ts_ms"), F.round("value", 4).alias("llm_result"))
    return history.cache_latest(w, ["item_id", "page", "action"]).select("item_id", "page", "action", "ts_ms", "llm_result")


# one parent and title has every job and every other attachment: an equi-join would make all pairs
@query("output_candidates_hot", """WITH j AS (SELECT o_orderkey AS job_id, epoch_ms(o_orderdate) AS created_ms FROM orders), a AS (SELECT l_orderkey * 10 + l_linenumber AS attachment_id, (l_orderkey * 7919 + l_linenumber) % 100003 AS ord, epoch_ms(l_shipdate) AS added_ms FROM lineitem WHERE l_linenumber % 2 = 1),
r AS (SELECT *, min(k) OVER (ORDER BY tm DESC, job ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM (SELECT NULL AS job_id, added_ms AS tm, ord::HUGEINT * 1000000000000 + attachment_id AS k, 0 AS job FROM a UNION ALL SELECT job_id, created_ms - 60000, NULL, 1 FROM j))
SELECT job_id, (best % 1000000000000)::BIGINT AS attachment_id FROM r WHERE job = 1 AND best IS NOT NULL""")
def output_candidates_hot(spark, sf):
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    one = [F.lit(1).cast("bigint").alias("parent_id"), F.lit("t").alias("title")]
    j = t(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), *one, ms("o_orderdate").alias("created_ms"))
    a = t(spark, sf, "lineitem").where(F.col("l_linenumber") % 2 == 1)
    a = a.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("attachment_id"), ((F.col("l_orderkey") * 7919 + F.col("l_linenumber")) % 100003).alias("ord"), *one, ms("l_shipdate").alias("added_ms"), F.lit("text/html").alias("content_type"), F.lit(True).alias("file_exists"))
    return history.output_candidates(j, a)


@query("output_candidates", """WITH j AS (SELECT o_orderkey AS job_id, o_custkey AS parent_id, o_orderpriority AS title, epoch_ms(o_orderdate) AS created_ms FROM orders), a AS (SELECT o_orderkey AS attachment_id, o_custkey AS parent_id, o_orderpriority AS title, epoch_ms(o_orderdate) AS added_ms, o_orderkey % 5 <> 0 AS html, o_orderkey % 7 <> 0 AS there FROM orders)
SELECT j.job_id, a.attachment_id FROM j JOIN a ON a.parent_id = j.parent_id AND a.title = j.title AND a.html AND a.there AND a.added_ms >= j.created_ms - 60000 QUALIFY row_number() OVER (PARTITION BY j.job_id ORDER BY a.attachment_id) = 1""")
def output_candidates(spark, sf):
    o = t(spark, sf, "orders")
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    j = o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("parent_id"), F.col("o_orderpriority").alias("title"), ms.alias("created_ms"))
    a = o.select(F.col("o_orderkey").alias("attachment_id"), F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("parent_id"), F.col("o_orderpriority").alias("title"), ms.alias("added_ms"), F.when(F.col("o_orderkey") % 5 != 0, "text/html").otherwise("application/pdf").alias("content_type"), (F.col("o_orderkey") % 7 != 0).alias("file_exists"))
    return history.output_candidates(j, a)


@query("source_resolve", """WITH i AS (SELECT c_custkey AS item_id, c_custkey % 4 = 0 AS pdf FROM customer), a AS (SELECT o_custkey AS parent_id, o_orderkey AS attachment_id, o_orderkey % 2 = 0 AS pdf, o_orderkey % 3 <> 0 AS there FROM orders),
b AS (SELECT item_id, item_id AS attachment_id, -1 AS ord FROM i WHERE pdf UNION ALL SELECT i.item_id, a.attachment_id, a.attachment_id FROM i JOIN a ON a.parent_id = i.item_id WHERE NOT i.pdf AND a.pdf AND a.there) SELECT item_id, arg_min(attachment_id, ord) AS attachment_id FROM b GROUP BY item_id""")
def source_resolve(spark, sf):
    items = t(spark, sf, "customer").select(F.col("c_custkey").alias("item_id"), (F.col("c_custkey") % 4 == 0).alias("is_pdf"))
    att = t(spark, sf, "orders").select(F.col("o_custkey").alias("parent_id"), F.col("o_orderkey").alias("attachment_id"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 2 == 0).alias("is_pdf"), (F.col("o_orderkey") % 3 != 0).alias("file_exists"))
    return history.resolve_sources(items, att)


# positioned items from line items: an order is a page
_ITEMS = """items AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord, 'w' || l_partkey AS str, ((l_partkey % 3) * 180 + l_suppkey % 10)::DOUBLE AS x, (700 - (l_linenumber // 2) * 14 - (l_partkey % 4))::DOUBLE AS y, (8 + l_suppkey % 5)::DOUBLE AS height FROM lineitem)"""


def _items(spark, sf):
    r = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    e = F.expr
    return t(spark, sf, "lineitem").withColumn("_r", r).select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("_r").alias("ord"), e("'w' || l_partkey").alias("str"), e("double((l_partkey % 3) * 180 + l_suppkey % 10)").alias("x"),
        e("double(700 - (l_linenumber div 2) * 14 - (l_partkey % 4))").alias("y"), F.lit(10.0).alias("width"), e("double(8 + l_suppkey % 5)").alias("height"),
    )


_COLS = """b AS (SELECT doc_id, (floor(floor(x + 0.5) / 20 + 0.5) * 20)::BIGINT AS b, count(*) AS n FROM items GROUP BY ALL), w AS (SELECT doc_id, sum(n) AS total FROM b GROUP BY doc_id),
k AS (SELECT b.doc_id, any_value(total) AS total, list(b.b ORDER BY b.b) FILTER (WHERE b.n >= total * 0.15) AS bs FROM b JOIN w ON w.doc_id = b.doc_id GROUP BY b.doc_id), cols AS (SELECT doc_id, CASE WHEN total >= 4 AND coalesce(bs[2] - bs[1] > 100, false) THEN 2 ELSE 1 END AS columns FROM k)"""
_LINED = """placed AS (SELECT i.*, CASE WHEN c.columns = 2 AND i.x >= (min(i.x) OVER (PARTITION BY i.doc_id) + max(i.x) OVER (PARTITION BY i.doc_id)) / 2 THEN 1 ELSE 0 END AS col_no FROM items i JOIN cols c ON c.doc_id = i.doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, col_no ORDER BY y DESC, x, ord) AS rn FROM placed),
r AS (SELECT doc_id, col_no, ord, rn, y AS anchor, 0 AS line_no FROM o WHERE rn = 1 UNION ALL SELECT o.doc_id, o.col_no, o.ord, o.rn, CASE WHEN abs(o.y - r.anchor) < o.height * 0.5 THEN r.anchor ELSE o.y END, CASE WHEN abs(o.y - r.anchor) < o.height * 0.5 THEN r.line_no ELSE r.line_no + 1 END
 FROM r JOIN o ON o.doc_id = r.doc_id AND o.col_no = r.col_no AND o.rn = r.rn + 1),
ln AS (SELECT r.doc_id, r.col_no, r.line_no, any_value(r.anchor) AS y, max(o.height) AS height, string_agg(o.str, '' ORDER BY o.x, o.ord) AS text FROM r JOIN o ON o.doc_id = r.doc_id AND o.col_no = r.col_no AND o.rn = r.rn GROUP BY ALL)"""


@query("column_detect", f"WITH {_ITEMS}, {_COLS} SELECT doc_id, columns FROM cols")
def column_detect(spark, sf):
    return layout.detect_columns(_items(spark, sf)).select("doc_id", "columns")


@query("line_group", f"WITH RECURSIVE {_ITEMS}, {_COLS}, {_LINED} SELECT doc_id, col_no, line_no, y, height, text FROM ln")
def line_group(spark, sf):
    return layout.lines(_items(spark, sf)).select("doc_id", "col_no", "line_no", "y", "height", "text")


@query("paragraph_rebuild", f"""WITH RECURSIVE {_ITEMS}, {_COLS}, {_LINED}, g AS (SELECT *, CASE WHEN lag(y) OVER w - y > avg(height) OVER (PARTITION BY doc_id, col_no) * 1.5 THEN 1 ELSE 0 END AS new FROM ln WINDOW w AS (PARTITION BY doc_id, col_no ORDER BY line_no)),
p AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, col_no ORDER BY line_no) AS par FROM g), q AS (SELECT doc_id, col_no, par, string_agg(text, ' ' ORDER BY line_no) AS text FROM p GROUP BY ALL) SELECT doc_id, string_agg(text, chr(10) ORDER BY col_no, par) AS raw_text FROM q GROUP BY doc_id""")
def paragraph_rebuild(spark, sf):
    return layout.page_text(_items(spark, sf)).select("doc_id", "raw_text")


@query("sse_reassemble", "SELECT doc_id, md5(text) AS text_md5, true AS done FROM documents")
def sse_reassemble(spark, sf):
    """Every document as an event stream of one event a line of text, cut into chunks of 97 characters, junk after the end mark."""
    rows = t(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("ls"))
    event = lambda x, i: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.concat(F.when(i > 0, "\n").otherwise(""), x).alias("content")).alias("delta"))).alias("choices"))), F.lit("\n\n"))
    whole = F.concat(F.lit(": hi\n"), F.array_join(F.transform("ls", event), ""), F.lit('data: [DONE]\ndata: {"choices":[{"delta":{"content":"late"}}]}\n'))
    streams = rows.select("doc_id", whole.alias("w"))
    chunks = streams.select(F.col("doc_id").alias("request_id"), "w", F.posexplode(F.sequence(F.lit(1), F.length("w"), F.lit(97))).alias("seq", "at")).select("request_id", "seq", F.substring("w", F.col("at"), F.lit(97)).alias("chunk"))
    return sse.reassemble(chunks).select(F.col("request_id").alias("doc_id"), F.md5("text").alias("text_md5"), "done")


@query("redact", f"WITH {LINES} SELECT doc_id, pos::BIGINT AS pos, 'a <redacted-api-key> b ' || line || ' <redacted-token>' AS shown FROM lines")
def redact(spark, sf):
    jwt = "eyJ" + "a" * 24 + "." + "b" * 24 + "." + "c" * 24
    return doc_lines(spark, sf).select("doc_id", long("pos").alias("pos"), fx.redact(F.concat(F.lit("a sk-abcDEF12345 b "), "line", F.lit(f" {jwt}"))).alias("shown"))


@query("safe_filename", rf"SELECT p_partkey, substring({TRIM.format("regexp_replace('a' || p_partkey || '_' || p_name || '__ ' || p_type, '\\s+', ' ', 'g')")}, 1, 140) || '（双语）.html' AS name, regexp_replace(p_brand, '[^A-Za-z0-9_-]', '_', 'g') AS folder FROM part")
def safe_filename(spark, sf):
    title = F.concat(F.lit(" a"), F.col("p_partkey").cast("string"), F.lit(":"), "p_name", F.lit("?\t "), "p_type")
    return t(spark, sf, "part").select("p_partkey", fx.safe_filename(title).alias("name"), fx.safe_directory(F.col("p_brand")).alias("folder"))


@query("selection_prompt", """SELECT p_partkey, '请将以下' || w || '翻译成 zh-CN。' || chr(10) || chr(10) || '【待翻译' || w || '】' || chr(10) || p_name || chr(10) || chr(10) || '【' || c || '】' || chr(10) || p_type || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || chr(10) || '【术语参考】' || chr(10) || p_brand || ' → x' || CASE WHEN p_partkey % 4 = 0 THEN ' (f)' ELSE '' END ELSE '' END AS content
FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN '词' WHEN 1 THEN '句子' ELSE '段落' END AS w, CASE p_partkey % 3 WHEN 0 THEN '所在句子' WHEN 1 THEN '所在段落' ELSE '上下文' END AS c FROM part)""")
def selection_prompt(spark, sf):
    e = F.expr
    rows = t(spark, sf, "part").select(
        "p_partkey", e("cast(p_partkey % 3 + 1 as int)").alias("level"), F.col("p_name").alias("selected"), F.col("p_type").alias("context"), F.lit("zh-CN").alias("target_language"), F.lit(False).alias("has_dict"),
        e("case when p_partkey % 2 = 0 then array(named_struct('term', p_brand, 'translation', 'x', 'field', case when p_partkey % 4 = 0 then 'f' end)) end").alias("terms"),
    )
    return prompt.selection_prompt(rows).select("p_partkey", F.col("messages")[1]["content"].alias("content"))


@query("batch_payload", f"""WITH {LINES} SELECT doc_id, (pos // 8)::BIGINT AS batch_no, md5(string_agg('@@' || printf('b%04d', pos + 1) || chr(10) || line, chr(10) || chr(10) ORDER BY pos)) AS text_md5 FROM lines GROUP BY doc_id, pos // 8""")
def batch_payload(spark, sf):
    rows = doc_lines(spark, sf).select("doc_id", long(F.floor(F.col("pos") / 8)).alias("batch_no"), "pos", F.format_string("b%04d", F.col("pos") + 1).alias("id"), F.lit("paragraph").alias("type"), F.col("line").alias("source"))
    return prompt.batch_payloads(rows).select("doc_id", "batch_no", F.md5("text").alias("text_md5"))


@query("glossary_sample", f"WITH {LINES} SELECT doc_id, md5(substring(string_agg(line, chr(10) || chr(10) ORDER BY pos), 1, 12000)) AS sample_md5 FROM lines WHERE pos < 30 GROUP BY doc_id")
def glossary_sample(spark, sf):
    rows = doc_lines(spark, sf).select("doc_id", "pos", F.lit("paragraph").alias("type"), F.col("line").alias("source"))
    return prompt.glossary_sample(rows).select("doc_id", F.md5("sample").alias("sample_md5"))


@query("response_split", f"""WITH a AS (SELECT doc_id, string_split(text || CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) || '---' || chr(10) || ' note ' || doc_id || ' ---more' END, '---') AS p FROM documents)
SELECT doc_id, {TRIM.format('p[1]')} AS translation, nullif({TRIM.format('p[2]')}, '') AS analysis FROM a""")
def response_split(spark, sf):
    answer = F.expr("text || case when doc_id % 3 = 0 then '' else '\\n---\\n note ' || doc_id || ' ---more' end")
    return t(spark, sf, "documents").select("doc_id", fx.split_response(answer, F.lit(2)).alias("r")).select("doc_id", "r.translation", "r.analysis")


@query("fulltext_title", "SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN text ELSE '# T' || doc_id || ' x' || chr(10) || chr(10) || text END) AS markdown_md5 FROM documents")
def fulltext_title(spark, sf):
    title = F.when(F.col("doc_id") % 2 == 0, F.substring("text", 3, 20)).otherwise(F.concat(F.lit("T"), F.col("doc_id").cast("string"), F.lit(" x ")))
    return t(spark, sf, "documents").select("doc_id", F.md5(fx.with_title(F.col("text"), title)).alias("markdown_md5"))


@query("missing_report", f"WITH {LINES}, {_BLOCKS}, m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM blocks WHERE type = 'paragraph' AND coalesce(translation, '') = '') SELECT doc_id, count(*)::BIGINT AS n_missing, string_agg(id, ',' ORDER BY pos) FILTER (WHERE n <= 12) AS first_ids FROM m GROUP BY doc_id")
def missing_report(spark, sf):
    return validate.missing_report(_state_blocks(spark, sf)).select("doc_id", "n_missing", F.array_join("first_ids", ",").alias("first_ids"))


@query("progress_counts", f"WITH {LINES}, {_BLOCKS} SELECT doc_id, count(*) FILTER (WHERE type <> 'image')::BIGINT AS translatable, count(*) FILTER (WHERE type <> 'image' AND translation <> '')::BIGINT AS translated, count(*) FILTER (WHERE type <> 'image' AND coalesce(translation, '') = '')::BIGINT AS pending FROM blocks GROUP BY doc_id")
def progress_counts(spark, sf):
    b = _state_blocks(spark, sf)
    kind, tr = F.col("type"), F.coalesce("translation", F.lit(""))
    return b.groupBy("doc_id").agg(F.count_if(fx.is_translatable(kind)).alias("translatable"), F.count_if(fx.is_translatable(kind) & (tr != "")).alias("translated"), F.count_if(fx.is_pending(kind, F.col("translation"), F.lit("x"))).alias("pending"))
