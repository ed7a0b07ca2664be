"""Translation history, caches and outputs: search, caps, deletions, latest entries, titles, output candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import blank_to_null, fingerprint, first_filled, js_trim
from quire.sources.scratch import keep

# Records kept for a library; milliseconds an output may be older than its job.
MOST, SLACK_MS = 1000, 60_000
#: Milliseconds of a span of :func:`output_candidates`.
SPAN_MS = 86_400_000
SEARCHED = ("selected", "context", "result", "item_title", "library_name", "operation", "phonetic", "translation")


def _searched(fields: tuple[str, ...]) -> Column:
    return F.lower(F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]), "\n"))


def search(history: DataFrame, query: str, fields: tuple[str, ...] = SEARCHED) -> DataFrame:
    """Rows whose joined fields hold the query (trimmed, either case); a blank query keeps all. Nulls count as empty fields."""
    q = query.strip().lower()
    return history.where(F.instr(_searched(fields), q) > 0) if q else history


#: Characters of a gram; grams of a search, its rarest ones, that a row must have before its text is looked at.
GRAM, RAREST = 3, 4
#: Tasks that the rows of a gram are dealt to.
SPREAD = 16


def _grams(text: Column) -> Column:
    """Distinct grams of a text, from each of its characters on (the last ones are shorter); the text is cut to characters once."""
    three = lambda cs, i: F.concat(*[F.coalesce(F.get(cs, i + k), F.lit("")) for k in range(GRAM)])
    cut = F.transform(F.array(F.split(text, "")), lambda cs: F.array_distinct(F.transform(cs, lambda _, i: three(cs, i))))
    return F.get(cut, F.lit(0))


def gram_index(history: DataFrame, fields: tuple[str, ...] = SEARCHED, key: str = "id") -> DataFrame:
    """(gram, key): posting lists of all rows. Write it bucketed or sorted by gram and hand it to any number of searches."""
    return history.select(F.explode(_grams(_searched(fields))).alias("gram"), F.col(key).alias("_key"))


def search_many(searches: DataFrame, history: DataFrame, index: DataFrame | None = None, fields: tuple[str, ...] = SEARCHED, key: str = "id") -> DataFrame:
    """(query_id, key) of every row of history that a search (query_id, query) finds, for many searches in one job, as :func:`search` defines it.

    A row must have the search's ``RAREST`` rarest grams (an equi-join on the index, counted), then the text decides. A search of one
    or two characters is the beginning of a gram wherever it stands; a blank one finds every row. ``key`` tells the rows apart.
    Equal searches are one until the end. The rows of a gram are dealt to ``SPREAD`` tasks by their key, as some grams are in every row.
    """
    index = keep(gram_index(history, fields, key), "grams") if index is None else index
    ids = searches.select("query_id", F.lower(F.btrim(F.coalesce("query", F.lit("")), F.lit(" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"))).alias("_q")).distinct()
    asked = ids.select("_q").distinct()
    whole = asked.where(F.length("_q") >= GRAM).select("_q", F.explode(F.filter(_grams(F.col("_q")), lambda g: F.length(g) == GRAM)).alias("gram"))
    often = index.join(whole.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    need = Window.partitionBy("_q")
    rated = whole.join(often, "gram", "left").withColumn("_r", F.row_number().over(need.orderBy(F.coalesce("_n", F.lit(0)), "gram"))).where(F.col("_r") <= RAREST)
    rare = rated.select("_q", "gram", F.col("_r"), F.count(F.lit(1)).over(need).alias("_need")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    dealt = index.withColumn("_part", F.pmod(F.xxhash64("_key"), F.lit(SPREAD)).cast("int"))
    met = F.bit_count(F.bit_or(F.expr("shiftleft(1, _r - 1)")))
    long = dealt.join(rare, ["gram", "_part"]).groupBy("_q", "_key", "_need").agg(met.alias("_met")).where("_met = _need").select("_q", "_key")
    short = [index.join(asked.where(F.length("_q") == n).withColumn("_begin", F.col("_q")), F.substring("gram", 1, n) == F.col("_begin")).select("_q", "_key") for n in range(1, GRAM)]
    every = history.select(F.col(key).alias("_key"), F.lit("").alias("_begin")).join(asked.where("_q = ''"), F.col("_begin") == F.col("_q")).select("_q", "_key")
    sure = short[0].unionByName(short[1]).unionByName(every)
    texts = history.select(F.col(key).alias("_key"), _searched(fields).alias("_text"))
    held = long.join(texts, "_key").where(F.contains("_text", F.col("_q"))).select("_q", "_key")
    found = held.unionByName(sure).distinct()
    return found.join(ids, "_q").select("query_id", F.col("_key").alias(key)).distinct()


def by_item(history: DataFrame, item_id) -> DataFrame:
    return history.where(F.col("item_id") == item_id)


def by_time(history: DataFrame, ascending: bool = False) -> DataFrame:
    key = F.col("ts_ms")
    return history.orderBy(key if ascending else key.desc(), "ord")


def newest(history: DataFrame, most: int = MOST) -> DataFrame:
    """Append-front with a cap: the last rows of each library."""
    r = F.row_number().over(Window.partitionBy("library_id").orderBy(F.col("ord").desc()))
    return history.withColumn("rank", r).where(F.col("rank") <= most)


def append(history: DataFrame, records: DataFrame, most: int = MOST) -> DataFrame:
    """New records go to the front (their ord follows the library's last), and what is over the cap goes."""
    last = history.groupBy("library_id").agg(F.max("ord").alias("_last"))
    moved = records.join(last, "library_id", "left").withColumn("ord", F.col("ord") + F.coalesce("_last", F.lit(-1)) + 1).select(*history.columns)
    return newest(history.unionByName(moved), most)


def delete(history: DataFrame, gone: DataFrame) -> DataFrame:
    return history.join(gone.select("library_id", "id"), ["library_id", "id"], "left_anti")


def union_libraries(histories: DataFrame, libraries: DataFrame) -> DataFrame:
    """Rows of all libraries that aren't feeds, with the library's name, newest first (equal times: by library, then by ord, if there is one)."""
    named = libraries.where(~F.coalesce("is_feed", F.lit(False))).select("library_id", "library_name")
    return histories.join(named, "library_id").orderBy(F.col("ts_ms").desc(), "library_id", *[c for c in ("ord", "id") if c in histories.columns])


def item_titles(history: DataFrame, items: DataFrame, fallback: str = "?") -> DataFrame:
    """Adds item_title: the parent's title, else the item's own, else the fallback."""
    own = items.select(F.col("item_id"), F.col("parent_id").alias("_p"), F.col("title").alias("_t"))
    parent = items.select(F.col("item_id").alias("_p"), F.col("title").alias("_pt"))
    joined = history.join(own, "item_id", "left").join(parent, "_p", "left")
    return joined.withColumn("item_title", F.coalesce(blank_to_null(F.col("_pt")), blank_to_null(F.col("_t")), F.lit(fallback))).drop("_p", "_t", "_pt")


def normal_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(js_trim(text), r"\s+", " "))


def cache_latest(writes: DataFrame, keys: list[str]) -> DataFrame:
    """The last write of each key, tombstones (ts_ms <= 0) gone."""
    rest = [c for c in writes.columns if c not in keys]
    last = writes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "ord").alias("w"))
    return last.select(*keys, "w.*").where("ts_ms > 0")


def cache_without(cache: DataFrame, item_ids: DataFrame | None = None) -> DataFrame:
    """The cache without all entries of some items (item_id), or with none at all."""
    return cache.limit(0) if item_ids is None else cache.join(item_ids.select("item_id"), "item_id", "left_anti")


def page_memo(texts: DataFrame, requests: DataFrame) -> DataFrame:
    """Texts of the pages (doc_id, page) asked for, read once however often they are; a page that isn't there is null."""
    once = texts.join(requests.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi").dropDuplicates(["doc_id", "page"])
    return requests.join(once, ["doc_id", "page"], "left")


def probe(requests: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    return requests.join(cache, keys, "left")


def output_candidates(jobs: DataFrame, attachments: DataFrame) -> DataFrame:
    """job_id, attachment_id: the first HTML attachment of the job's parent and title that is no older than a minute before the job and whose file exists.

    An as-of join: jobs and attachments of a parent and title are one run in order of time, and jobs read the least (ord, id) from their
    time on. Spans of a day are tasks of their own, so one parent and title with any number of jobs is split.
    """
    key = ["parent_id", "title"]
    fit = attachments.where((F.col("content_type") == "text/html") & F.col("file_exists"))
    fit = fit.select(*key, F.col("added_ms").alias("_at"), F.struct("ord", "attachment_id").alias("_a"), F.lit(None).cast(jobs.schema["job_id"].dataType).alias("job_id"), F.lit(False).alias("_job"))
    asked = jobs.select(*key, (F.col("created_ms") - SLACK_MS).alias("_at"), F.lit(None).cast(fit.schema["_a"].dataType).alias("_a"), "job_id", F.lit(True).alias("_job"))
    run = fit.unionByName(asked).where("parent_id is not null and title is not null and _at is not null").withColumn("_span", F.floor(F.col("_at") / SPAN_MS))
    # the best attachment from a job's time on: inside its span of time by a running minimum, in later spans by one over the spans' minima
    inside = Window.partitionBy(*key, "_span").orderBy(F.desc("_at"), "_job").rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*key).orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1)
    spans = run.groupBy(*key, "_span").agg(F.min("_a").alias("_best")).withColumn("_later", F.min("_best").over(later)).drop("_best")
    found = run.withColumn("_here", F.min("_a").over(inside)).where("_job").join(spans, [*key, "_span"])
    best = found.groupBy("job_id").agg(F.min(F.least("_here", "_later")).alias("_b"))
    return best.where("_b is not null").select("job_id", "_b.attachment_id")


def output_targets(jobs: DataFrame, attachments: DataFrame) -> DataFrame:
    """job_id, attachment_id, action: the output a job wrote before is updated if its file exists, else a candidate is adopted, else one is created."""
    there = attachments.where("file_exists").select(F.col("attachment_id").alias("output_id"), F.lit(True).alias("_own"))
    own = jobs.join(there, "output_id", "left")
    found = output_candidates(jobs, attachments).withColumnRenamed("attachment_id", "_found")
    action = F.when(F.col("_own"), "update").when(F.col("_found").isNotNull(), "adopt").otherwise("create")
    return own.join(found, "job_id", "left").select("job_id", F.when(F.col("_own"), F.col("output_id")).otherwise(F.col("_found")).alias("attachment_id"), action.alias("action"))


def resolve_sources(items: DataFrame, attachments: DataFrame) -> DataFrame:
    """item_id, attachment_id: the item itself if it is a PDF, else its first PDF child whose file exists."""
    own = items.where("is_pdf").select("item_id", F.col("item_id").alias("attachment_id"), F.lit(-1).cast("bigint").alias("ord"))
    child = attachments.where("is_pdf and file_exists").select(F.col("parent_id").alias("item_id"), "attachment_id", F.col("ord").cast("bigint").alias("ord"))
    r = F.row_number().over(Window.partitionBy("item_id").orderBy("ord"))
    both = own.unionByName(child.join(items.where("not is_pdf").select("item_id"), "item_id", "left_semi"))
    return both.withColumn("_r", r).where("_r = 1").select("item_id", "attachment_id")


def project_sources(items: DataFrame, attachments: DataFrame, libraries: DataFrame) -> DataFrame:
    """item_id, attachment_id, title, creators, fingerprint, error of items (item_id, library_id, title, creators, is_pdf, key, size, mtime):
    what a job starts from; the error says that there is no PDF or that the library can't be written to."""
    chosen = resolve_sources(items.select("item_id", "is_pdf"), attachments)
    facts = attachments.select("attachment_id", "key", "size", "mtime").unionByName(items.where("is_pdf").select(F.col("item_id").alias("attachment_id"), "key", "size", "mtime"))
    joined = items.drop("key", "size", "mtime").join(chosen, "item_id", "left").join(facts, "attachment_id", "left").join(libraries.select("library_id", "editable"), "library_id", "left")
    error = F.when(F.col("attachment_id").isNull(), "no PDF").when(~F.coalesce("editable", F.lit(False)), "read-only library")
    return joined.select("item_id", "attachment_id", first_filled(F.col("title")).alias("title"), F.coalesce("creators", F.lit("")).alias("creators"), F.when(F.col("attachment_id").isNotNull(), fingerprint(F.col("key"), F.col("size"), F.col("mtime"))).alias("fingerprint"), error.alias("error"))


def match_assets(images: DataFrame, assets: DataFrame) -> DataFrame:
    """images (doc_id, src) with relative_path of the first asset that equals the source or ends with its file name.

    The first asset of each path and of each file name is found before images meet assets, so an image meets one row of each,
    however many assets share its name.
    """
    plain = lambda c: F.replace(F.col(c), F.lit("\\"), F.lit("/"))
    tail = lambda c: F.element_at(F.split(c, "/"), -1)
    a = assets.select("doc_id", plain("original_path").alias("_src"), F.struct("ord", "relative_path").alias("_a"))
    first = lambda rows, key, name: rows.groupBy("doc_id", key).agg(F.min_by("_a", "_a.ord").alias(name))
    whole = first(a, "_src", "_whole")
    named = first(a.where(F.col("_src").contains("/")).withColumn("_base", tail(F.col("_src"))), "_base", "_named")
    wanted = images.select("doc_id", "src").distinct().withColumn("_src", plain("src")).withColumn("_base", tail(F.col("_src")))
    met = wanted.join(whole, ["doc_id", "_src"], "left").join(named, ["doc_id", "_base"], "left")
    earlier = F.when(F.col("_named.ord") < F.col("_whole.ord"), F.col("_named")).otherwise(F.coalesce("_whole", "_named"))
    return images.join(met.select("doc_id", "src", earlier["relative_path"].alias("relative_path")), ["doc_id", "src"], "left")
