"""Dictionaries and glossaries: ingest, lookup, substring and word-border matching, merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import is_lookup_candidate, js_trim
from quire.operators.automaton import Automaton, Tiers, by_value, first_hits, slices, text_bytes
from quire.sources.batches import bound_batches
from quire.sources.scratch import keep

# Terms in a prompt, terms of a paper, terms taken from a model, from how many entries a dictionary is the full one.
PROMPT_TERMS, PAPER_TERMS, GENERATED_TERMS, FULL_DICTIONARY = 53, 40, 30, 200_000


def csv_fields(line: Column) -> Column:
    """Fields of a line: quotes toggle and vanish, commas split outside of them (no escapes, no multi-line fields)."""
    return F.transform(F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*\\z)'), lambda f: F.replace(f, F.lit('"'), F.lit("")))


def _number(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(c, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint"), F.lit(0))


def ingest_dictionary(lines: DataFrame, kind: str = "full") -> DataFrame:
    """word, phonetic, translation, pos from (line_no, value) of a 13-column CSV; the header goes, the last line of a word wins.
    "light" keeps words with a frequency, a rank, a star or a tag."""
    f = csv_fields(F.col("value"))
    at = lambda i: F.coalesce(F.get(f, F.lit(i)), F.lit(""))
    rows = lines.where("line_no > 0").select("line_no", F.lower(js_trim(at(0))).alias("word"), js_trim(at(1)).alias("phonetic"), js_trim(at(3)).alias("translation"), js_trim(at(4)).alias("pos"), *[_number(at(i)).alias(n) for n, i in (("collins", 5), ("oxford", 6), ("bnc", 8), ("frq", 9))], js_trim(at(7)).alias("tag"))
    kept = rows.where((F.col("word") != "") & (F.col("translation") != "") & ~F.col("word").contains(" ") & F.col("word").rlike("^[a-z]"))
    if kind == "light":
        kept = kept.where("bnc <> 0 or frq <> 0 or collins <> 0 or oxford <> 0 or tag <> ''")
    best = kept.groupBy("word").agg(F.max_by(F.struct("phonetic", "translation", "pos"), "line_no").alias("e"))
    return best.select("word", "e.phonetic", "e.translation", "e.pos")


def dictionary_status(dictionary: DataFrame) -> DataFrame:
    n = dictionary.agg(F.count(F.lit(1)).alias("entries"))
    return n.withColumn("status", F.when(F.col("entries") == 0, "none").when(F.col("entries") < FULL_DICTIONARY, "light").otherwise("full"))


def look_up(words: DataFrame, dictionary: DataFrame, word: str = "word") -> DataFrame:
    """Left join on the lower-cased word; only single ASCII words are looked up. Catalyst broadcasts a small dictionary."""
    key = F.when(is_lookup_candidate(F.col(word)), F.lower(js_trim(F.col(word))))
    entry = dictionary.select(F.col("word").alias("_key"), "phonetic", "translation", "pos")
    return words.withColumn("_word", key).join(entry, F.col("_word") == F.col("_key"), "left").drop("_word", "_key")


def entry_lists(glossary: DataFrame, columns: tuple[str, ...] = ("term", "translation", "field", "note")) -> DataFrame:
    """One ordered array of entries for each library."""
    return glossary.groupBy("library_id").agg(F.array_sort(F.collect_list(F.struct("ord", *columns))).alias("entries"))


def _keyed(texts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """With the keys as one value, in which nulls are equal."""
    return texts.withColumn("_by", F.struct(*keys))


#: Bytes of all terms up to which a glossary travels to every task; of an automaton's terms beyond, of the texts that meet it at a time.
TERM_BYTES, GROUP_BYTES = 1 << 18, 1 << 26
_ENTRY = "struct<ord:bigint,term:string,translation:string,field:string,note:string>"
_lower = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))


def match_tiered(texts: DataFrame, glossary: DataFrame, most: int = PROMPT_TERMS, keys: tuple[str, ...] = ("library_id", "selected", "context"), term_bytes: int = TERM_BYTES) -> DataFrame:
    """texts (library_id, selected, context, ...) with terms: those in the selection first, then those in the context only.

    A library's lower-cased terms are one automaton that reads each text once. A glossary whose terms have up to ``term_bytes``
    bytes in all goes to every task, and texts are never shuffled; a larger one is dealt to automata of that size, and texts meet
    each of their library's. The empty term stands in every text. ``keys`` name columns that tell texts apart (with library_id).
    """
    bound_batches(texts.sparkSession)
    entries = glossary.select("library_id", F.col("ord").cast("bigint").alias("ord"), "term", "translation", "field", "note", F.lower("term").alias("_low"))
    size = F.octet_length("_low") + sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in ("translation", "field", "note"))
    terms, whole = entries.agg(F.coalesce(F.sum(F.octet_length("_low")), F.lit(0)), F.coalesce(F.sum(size), F.lit(0))).first()
    if terms <= term_bytes and whole <= 32 * TERM_BYTES:
        return _tiered_everywhere(texts, entries, most)
    return _tiered_dealt(texts, entries, most, keys, max(1, term_bytes))


def _tiered_everywhere(texts: DataFrame, entries: DataFrame, most: int) -> DataFrame:
    """One narrow stage; the entries, whose size is checked, are a broadcast value and their automata are built once a task."""
    held = entries.orderBy("library_id", "ord", "term", "translation", "field", "note").toArrow().combine_chunks()
    shared = texts.sparkSession.sparkContext.broadcast(held)
    names = [c for c in texts.columns if c != "terms"]
    n = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        shown = pa.StructArray.from_arrays([table[c].combine_chunks() if table.num_rows else pa.array([], t) for c, t in zip(("ord", "term", "translation", "field", "note"), (pa.int64(), *[pa.string()] * 4))], ["ord", "term", "translation", "field", "note"])
        low = table["_low"].to_pylist()
        places = dict(by_value(table["library_id"].combine_chunks())) if table.num_rows else {}
        tiers: dict = {}
        for batch in (part for whole in batches for part in slices(whole, (n + 1, n + 2))):
            found = [(np.zeros(0, np.int64),) * 3]
            for library, rows in by_value(batch.column(n)):
                if library in places:
                    if library not in tiers:
                        tiers[library] = Tiers([low[i] for i in places[library]])
                    chosen = batch.take(pa.array(rows))
                    row, tier, entry = tiers[library].hits(chosen.column(n + 1), chosen.column(n + 2))
                    found.append((rows[row], tier, places[library][entry]))
            entry, offsets = first_hits(*(np.concatenate(x) for x in zip(*found)), batch.num_rows, most)
            terms = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), shown.take(pa.array(entry)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], terms], [f"c{i}" for i in range(n + 1)])

    schema = T.StructType([T.StructField(f"c{i}", texts.schema[c].dataType) for i, c in enumerate(names)] + [T.StructField(f"c{n}", T._parse_datatype_string(f"array<{_ENTRY}>"))])
    lowered = texts.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.col("library_id").alias("_l"), _lower("selected").alias("_s"), _lower("context").alias("_c"))
    return lowered.mapInArrow(run, schema).toDF(*names, "terms")


def _tiered_dealt(texts: DataFrame, entries: DataFrame, most: int, keys: tuple[str, ...], term_bytes: int) -> DataFrame:
    """Terms are dealt by hash to automata of bounded size, a library's texts to groups of bounded size; an automaton comes before its
    texts in the order of its task, which holds one automaton and one batch at a time."""
    names = [c for c in texts.columns if c != "terms"]
    texts = texts.select(*names).withColumn("_by", F.struct("library_id", *keys))
    shards = entries.groupBy("library_id").agg(F.ceil(F.sum(F.octet_length("_low")) / term_bytes).alias("_shards"))
    groups = texts.groupBy("library_id").agg(F.ceil(F.sum(F.octet_length(_lower("selected")) + F.octet_length(_lower("context"))) / GROUP_BYTES).alias("_groups"))
    dealt = shards.join(groups, "library_id").select("library_id", F.greatest("_shards", F.lit(1)).alias("_shards"), F.greatest("_groups", F.lit(1)).alias("_groups"))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    none = F.lit(None)
    low = entries.where("_low <> ''").select("library_id", "_low").distinct().join(dealt, "library_id")
    automata = low.groupBy("library_id", F.pmod(F.xxhash64("_low"), F.col("_shards")).alias("_shard"), "_groups").agg(F.array_sort(F.collect_list("_low")).alias("_terms")).withColumn("_group", upto("_groups"))
    automata = automata.select("library_id", "_shard", "_group", F.lit(0).alias("_seq"), "_terms", none.cast("bigint").alias("_h1"), none.cast("bigint").alias("_h2"), none.cast("string").alias("_s"), none.cast("string").alias("_c"))
    # texts with the same keys are one text here, told apart by 128 bits
    own = (F.xxhash64(F.to_json("_by")), F.xxhash64(F.lit(1), F.to_json("_by")))
    readers = texts.join(dealt, "library_id").withColumn("_shard", upto("_shards")).withColumn("_h1", own[0])
    readers = readers.select("library_id", "_shard", F.pmod("_h1", F.col("_groups")).alias("_group"), F.lit(1).alias("_seq"), none.cast("array<string>").alias("_terms"), "_h1", own[1].alias("_h2"), _lower("selected").alias("_s"), _lower("context").alias("_c"))
    at = ["library_id", "_shard", "_group"]
    meeting = automata.unionByName(readers).repartition(*at).sortWithinPartitions(*at, "_seq").select("library_id", F.xxhash64(*at).alias("_at"), "_seq", "_terms", "_h1", "_h2", "_s", "_c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, tiers, of = [], None, None
        for batch in batches:
            group, seq = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for rows in np.split(np.arange(len(seq)), np.flatnonzero((np.diff(seq) != 0) | (np.diff(group) != 0)) + 1) if len(seq) else []:
                first = int(rows[0])
                if seq[first] == 0:
                    terms, tiers, of = batch.column(3)[first].as_py(), None, group[first]
                elif group[first] == of:  # else no term was dealt to the group
                    tiers = tiers or Tiers(terms)
                    for part in slices(batch.slice(first, len(rows)), (6, 7)):
                        row, tier, entry = tiers.hits(part.column(6), part.column(7))
                        own = [part.column(c).take(pa.array(row)) for c in (0, 4, 5)]
                        yield pa.RecordBatch.from_arrays([*own, pa.array(tier.astype(np.int32)), pa.array([terms[e] for e in entry], pa.string())], ["library_id", "_h1", "_h2", "tier", "_low"])

    library = texts.schema["library_id"].dataType.simpleString()
    hits = meeting.mapInArrow(run, f"library_id {library}, _h1 bigint, _h2 bigint, tier int, _low string").distinct()
    always = texts.select("library_id", own[0].alias("_h1"), own[1].alias("_h2"), F.lit(0).alias("tier"), F.lit("").alias("_low")).distinct()
    listed = hits.unionByName(always).join(entries, ["library_id", "_low"])
    order = F.struct("tier", *[F.col(c) for c in ("ord", "term", "translation", "field", "note")])
    best = F.transform(F.slice(F.array_sort(F.collect_list(order)), 1, most), lambda x: x.dropFields("tier"))
    found = listed.groupBy("_h1", "_h2").agg(best.cast(f"array<{_ENTRY}>").alias("terms"))
    joined = texts.withColumns({"_h1": own[0], "_h2": own[1]}).join(found, ["_h1", "_h2"], "left")
    return joined.select(*names, F.coalesce("terms", F.array().cast(f"array<{_ENTRY}>")).alias("terms"))


_RUN = "[A-Za-z0-9]+"


def _runs(c: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits; the two other characters that equal ASCII letters in the other case count as these."""
    return F.transform(F.regexp_extract_all(F.translate(c, "\u017f\u212a", "sk"), F.lit(_RUN), F.lit(0)), lambda w: F.lower(w))


#: A run's postings are dealt over so many parts, so that a run that every text holds isn't one task.
SALTS = 16


def _pieces(c: Column) -> Column:
    """Lower-cased text between the runs: before the first, between neighbours, after the last."""
    return F.transform(F.split(F.translate(c, "\u017f\u212a", "sk"), _RUN), lambda g: F.lower(g))


def _postings(texts: DataFrame) -> DataFrame:
    """_by, library_id, place, run, the gaps before and after it, and whether these begin and end the text."""
    # bound once: the text isn't cut again for each run
    bound = F.transform(F.array(F.struct(_runs(F.col("text")).alias("runs"), _pieces(F.col("text")).alias("gaps"))), lambda c: F.transform(c["runs"], lambda run, i: F.struct(
        i.cast("bigint").alias("place"), run.alias("run"), F.get(c["gaps"], i).alias("before"), F.get(c["gaps"], i + 1).alias("after"), (i == 0).alias("first"), (i == F.size(c["runs"]) - 1).alias("last"))))
    return texts.select("_by", "library_id", F.explode(F.get(bound, F.lit(0))).alias("p")).select("_by", "library_id", "p.*")


def _folded(c: Column) -> Column:
    """Lower-cased so that no other character becomes an ASCII letter, except the two that equal one in the other case, and that a sigma's
    form doesn't depend on its place."""
    return F.lower(F.translate(c, "\u017f\u212a\u0130\u03a3\u03c2", "sk\ufdd0\u03c3\u03c3"))


def _phrases(texts: DataFrame, entries: DataFrame, term_bytes: int = TERM_BYTES) -> DataFrame:
    """_by, library_id, ord, term of the terms (of several runs, or with other characters around one) that stand in a text.

    Terms of up to ``term_bytes`` bytes in all go to every task as automata that look at the borders of a match, so texts are read where
    they are; more of them are found by postings (:func:`_placed`)."""
    bound_batches(texts.sparkSession)
    low = entries.select("library_id", "ord", "term", _folded(F.col("term")).alias("_low"))
    if (low.agg(F.sum(F.octet_length("_low"))).first()[0] or 0) > term_bytes:
        return _placed(texts, entries)
    held = low.toArrow().combine_chunks()
    shared = texts.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        places = dict(by_value(table["library_id"].combine_chunks())) if table.num_rows else {}
        automata: dict = {}
        for batch in (part for whole in batches for part in slices(whole, (2,))):
            for library, rows in by_value(batch.column(1)):
                if library in places:
                    if library not in automata:
                        own = table.take(pa.array(places[library])).combine_chunks()
                        spelt = own["_low"].to_pylist()
                        distinct = sorted(set(spelt))
                        number = {t: i for i, t in enumerate(distinct)}
                        of = np.array([number[t] for t in spelt], np.int64)
                        automata[library] = own, np.argsort(of, kind="stable"), np.sort(of), Automaton(distinct)
                    own, order, of, automaton = automata[library]
                    chosen = batch.take(pa.array(rows))
                    row, term = automaton.bounded(*text_bytes(chosen.column(2)))
                    first, n = np.searchsorted(of, term), np.searchsorted(of, term, side="right") - np.searchsorted(of, term)
                    entry = order[np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                    row = pa.array(np.repeat(row, n))
                    yield pa.RecordBatch.from_arrays([chosen.column(0).take(row), chosen.column(1).take(row), *(own[c].combine_chunks().take(pa.array(entry)) for c in ("ord", "term"))], ["_by", "library_id", "ord", "term"])

    schema = T.StructType([texts.schema["_by"], texts.schema["library_id"], entries.schema["ord"], T.StructField("term", T.StringType())])
    return texts.where("text is not null").select("_by", "library_id", _folded(F.col("text")).alias("_c")).mapInArrow(run, schema)


def _placed(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """:func:`_phrases` by postings, for any number of terms.

    A term's rarest run in its library finds the places where the term may stand; there each of its runs must be in its place with
    the term's own gaps around it, which is an equi-join on (text, place). Nothing but postings of the terms' runs is shuffled.
    """
    runs, gaps = _runs(F.col("term")), _pieces(F.col("term"))
    asked = entries.select("library_id", "ord", "term", F.size(runs).alias("n"), F.posexplode(runs).alias("j", "run"), gaps.alias("gaps"))
    asked = asked.select("library_id", "ord", "term", "n", F.col("j").cast("bigint").alias("j"), "run", F.get("gaps", F.col("j")).alias("lead"), F.get("gaps", F.col("j") + 1).alias("tail"))
    wanted = asked.select("library_id", "run").distinct()
    postings = keep(_postings(texts).join(wanted, ["library_id", "run"], "left_semi"), "postings")
    often = postings.groupBy("library_id", "run").agg(F.count(F.lit(1)).alias("often"))
    rated = asked.join(often, ["library_id", "run"])
    rarest = rated.groupBy("library_id", "ord", "term", "n").agg(F.count(F.lit(1)).alias("known"), F.min(F.struct("often", "j", "run")).alias("r"))
    rarest = rarest.where(F.col("known") == F.col("n")).select("library_id", "ord", "term", F.col("r.j").alias("j"), F.col("r.run").alias("run"))
    salted = rarest.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    places = postings.withColumn("salt", F.pmod(F.xxhash64("place"), F.lit(SALTS)).cast("int")).join(salted, ["library_id", "run", "salt"])
    starts = places.where("place >= j").select("_by", "library_id", "ord", "term", (F.col("place") - F.col("j")).alias("start"))
    due = starts.join(asked, ["library_id", "ord", "term"]).withColumn("place", F.col("start") + F.col("j"))
    met = due.join(postings, ["_by", "library_id", "place", "run"])
    edge = lambda gap, own, end, side: F.when(end, side(gap, own) & (F.length(gap) > F.length(own)) | (gap == own)).otherwise(side(gap, own) & (F.length(gap) > F.length(own)))
    before = F.when(F.col("j") > 0, F.col("before") == F.col("lead")).otherwise(edge(F.col("before"), F.col("lead"), F.col("first"), F.endswith))
    after = F.when(F.col("j") < F.col("n") - 1, F.col("after") == F.col("tail")).otherwise(edge(F.col("after"), F.col("tail"), F.col("last"), F.startswith))
    whole = met.where(before & after).groupBy("_by", "library_id", "ord", "term", "start", "n").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") == F.col("n"))
    return whole.select("_by", "library_id", "ord", "term").distinct()


def match_bounded(texts: DataFrame, glossary: DataFrame, most: int = PAPER_TERMS, keys: tuple[str, ...] = ("library_id", "text")) -> DataFrame:
    """texts (library_id, text, ...) with terms: entries whose term stands in the text between non-alphanumeric characters.

    Every alphanumeric run of a term is a whole run of a text it stands in. A term that is one run meets the different runs of a text by an
    equi-join; other terms are found by their runs' places; only terms without any run are looked for in the
    texts. ``keys`` name columns that tell texts apart (with library_id); an id is cheaper than the text itself.
    """
    quoted = lambda t: F.regexp_replace(t, r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    pattern = lambda p: F.concat(F.lit("(?iu)(?:^|[^A-Za-z0-9])"), p, F.lit(r"(?:\z|[^A-Za-z0-9])"))
    texts, by = _keyed(texts, keys), ["_by", "library_id"]
    runs = _runs(F.col("term"))
    entries = glossary.where(js_trim(F.col("term")) != "").select("library_id", "ord", "term", F.get(runs, F.lit(0)).alias("_run"), F.translate("term", "\u017f\u212a", "sk").rlike(rf"^{_RUN}\z").alias("_one"), pattern(quoted(F.col("term"))).alias("pattern"))
    loose = entries.where("_run is null").groupBy("library_id").agg(F.collect_list(F.struct("ord", "term", "pattern")).alias("_loose"))
    words = texts.select(*by, F.explode(F.array_distinct(_runs(F.coalesce("text", F.lit(""))))).alias("_run"))
    salted = entries.where("_one").select("library_id", "_run", "ord", "term").withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    single = words.withColumn("_salt", F.pmod(F.xxhash64(F.to_json("_by")), F.lit(SALTS)).cast("int")).join(salted, ["library_id", "_run", "_salt"]).select(*by, "ord", "term")
    several = entries.where("_run is not null and not _one")
    hits = single.unionByName(_phrases(texts.select(*by, "text"), several)) if not several.isEmpty() else single
    met = hits.groupBy(*by).agg(F.collect_set(F.struct("ord", "term")).alias("_met"))
    none, pair = F.array().cast("array<struct<ord:bigint,term:string>>"), "array<struct<ord:bigint,term:string>>"
    joined = texts.join(met, by, "left").join(loose, "library_id", "left")
    others = F.transform(F.filter(F.coalesce("_loose", F.array().cast("array<struct<ord:bigint,term:string,pattern:string>>")), lambda e: F.coalesce(F.regexp_like("text", e["pattern"]), F.lit(False))), lambda e: e.dropFields("pattern"))
    found = F.array_sort(F.concat(F.coalesce(F.col("_met").cast(pair), none), others.cast(pair)))
    return joined.withColumn("terms", F.transform(F.slice(found, 1, most), lambda e: e["term"])).drop("_met", "_loose", "_by")


def merge_glossary(entries: DataFrame, fold_case: bool = True) -> DataFrame:
    """Last entry of a term wins, at the place of the first: (library_id, ord, term, translation, note)."""
    key = F.lower(js_trim(F.col("term"))) if fold_case else F.col("term")
    grouped = entries.groupBy("library_id", key.alias("_key")).agg(F.min("ord").alias("ord"), F.max_by(F.struct("term", "translation", "note"), "ord").alias("e"))
    return grouped.select("library_id", "ord", "e.*")


def upsert_glossary(entries: DataFrame) -> DataFrame:
    """Exact-term upsert that keeps the place."""
    return merge_glossary(entries, fold_case=False)


def merge_first(entries: DataFrame, most: int = PAPER_TERMS) -> DataFrame:
    """First entry of a term (either case) wins; at most ``most`` in order for each library."""
    once = entries.groupBy("library_id", F.lower(js_trim(F.col("term"))).alias("_key")).agg(F.min("ord").alias("ord"), F.min_by(F.struct("term", "translation", "note"), "ord").alias("e"))
    rank = F.row_number().over(Window.partitionBy("library_id").orderBy("ord"))
    return once.withColumn("_r", rank).where(F.col("_r") <= most).select("library_id", "ord", "e.*")


def append_entries(entries: DataFrame, imported: DataFrame) -> DataFrame:
    """An import goes behind what a library has, in its own order, without any merging."""
    names = [c for c in entries.columns if c not in ("library_id", "ord")]
    last = entries.groupBy("library_id").agg(F.max("ord").alias("_last"))
    moved = imported.join(last, "library_id", "left").select("library_id", (F.col("ord") + F.coalesce("_last", F.lit(-1)) + 1).alias("ord"), *[F.col(c) if c in imported.columns else F.lit(None).cast("string").alias(c) for c in names])
    return entries.select("library_id", "ord", *names).unionByName(moved)


def glossary_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("library_id").agg(F.count(F.lit(1)).alias("entries"))


def remove_terms(entries: DataFrame, terms: DataFrame) -> DataFrame:
    return entries.join(terms, ["library_id", "term"], "left_anti")


def to_csv(entries: DataFrame) -> DataFrame:
    """One CSV text for each library: header, then a value quoted only if it holds a comma."""
    value = lambda c: F.when(F.coalesce(F.col(c), F.lit("")).contains(","), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    line = F.concat_ws(",", *[value(c) for c in ("term", "translation", "field", "note")])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n")
    return entries.groupBy("library_id").agg(F.concat(F.lit("term,translation,field,note\n"), body).alias("csv"))


def from_csv(texts: DataFrame, strict: bool = False) -> DataFrame:
    """(library_id, csv) to entries: trimmed lines, blank ones and the first line dropped, split at every comma (``strict``: outside quotes)."""
    lines = F.filter(F.transform(F.split("csv", r"\r\n|\n|\r"), js_trim), lambda x: x != "")
    rows = texts.select("library_id", F.posexplode(lines).alias("pos", "line")).where("pos > 0")
    f = csv_fields(F.col("line")) if strict else F.split("line", ",")
    at = lambda i: F.regexp_replace(js_trim(F.get(f, F.lit(i))), r'^"|"\z', "")
    return rows.select("library_id", F.col("pos").cast("bigint").alias("ord"), at(0).alias("term"), at(1).alias("translation"), F.nullif(at(2), F.lit("")).alias("field"), F.nullif(at(3), F.lit("")).alias("note")).where("term <> '' and translation <> ''")


def from_tsv(lines: DataFrame) -> DataFrame:
    """(path, line_no, value) to (path, ord, term, translation, note): BOM and CR off, blank lines and an en/zh header dropped."""
    clean = lines.withColumn("value", F.regexp_replace(F.regexp_replace("value", "^﻿", ""), r"\r\z", "")).where(js_trim(F.col("value")) != "")
    f = F.split("value", "\t")
    at = lambda i: js_trim(F.coalesce(F.get(f, F.lit(i)), F.lit("")))
    first = F.row_number().over(Window.partitionBy("path").orderBy("line_no")) == 1
    rows = clean.withColumn("_first", first).where(~(F.col("_first") & (F.lower(at(0)) == "en") & (F.lower(at(1)) == "zh")))
    return rows.select("path", F.col("line_no").alias("ord"), at(0).alias("term"), at(1).alias("translation"), F.nullif(at(2), F.lit("")).alias("note")).where("term <> '' and translation <> ''")
