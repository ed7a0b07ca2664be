"""What goes to a translation model and comes back: protected spans, id and JSON answers, repair of translations."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as fx

# Span kinds with their patterns, in the order of their passes (true: either case).
SPANS = (
    ("CODE", r"```[\s\S]*?```|`[^`\n]+`", False),
    ("CODE", r"</?[A-Za-z][^>]*>", False),
    ("MATH", r"\$\$[\s\S]*?\$\$|\$[^$\n]+\$|\\\[[\s\S]*?\\\]", False),
    ("URL", r"https?://[^\s)>\]]+", False),
    ("DOI", r"\b10\.[0-9]{4,9}/[-._;()/:A-Z0-9]+\b", True),
    ("CIT", rf"\b{fx.AUTHOR}(?:\s+et al\.|\s+(?:and|&)\s+{fx.AUTHOR}|(?:,\s+{fx.AUTHOR}){{1,3}}(?:,?\s+(?:and|&)\s+{fx.AUTHOR})?)?\s*\({fx.YEAR}(?:,\s*(?:pp?\.\s*)?[0-9–—-]+)?\)", False),
    ("CIT", r"\([^()\n]{0,160}\b(?:18|19|20)[0-9]{2}[a-z]?(?:[^()\n]{0,160})\)", True),
)
TOKEN = r"⟦(?:CODE|MATH|URL|DOI|CIT)_[0-9]+⟧"


def _spelt(pattern: str, either_case: bool) -> str:
    """The pattern with ASCII word borders and the web's white space."""
    border = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    pattern = pattern.replace(r"[\s\S]", r"(?s:.)").replace(r"[^\s)", f"[^{fx.WS})").replace(r"\s", f"[{fx.WS}]").replace(r"\b", border)
    return ("(?i)" if either_case else "") + pattern


_PASSES = tuple((kind, _spelt(p, either)) for kind, p, either in SPANS)
# What every match of a pass holds (one of these); a text without them isn't searched by the pattern.
_HELD = (("`",), ("<",), ("$", "\\["), ("://",), ("10.",), ("(",), ("(",))


def protect_texts(rows: DataFrame, text: str = "source") -> DataFrame:
    """Adds protected and spans (array of token, value in order of creation; null texts are empty).

    Each pass takes out its matches and numbers their tokens on from the passes before, all by array functions. A pass runs its
    pattern over texts that hold one of its literals only, and cuts those only that have a match.
    """
    done = rows.withColumns({"protected": F.coalesce(F.col(text), F.lit("")), "spans": F.array().cast("array<struct<token:string,value:string>>")})
    names = done.columns
    for (kind, pattern), held in zip(_PASSES, _HELD):
        token = lambda i, k=kind: F.concat(F.lit(f"⟦{k}_"), (F.size("spans") + i).cast("string"), F.lit("⟧"))
        may = reduce(or_, [F.contains("protected", F.lit(x)) for x in held])
        found = done.withColumn("_m", F.when(may, F.regexp_extract_all("protected", F.lit(pattern), F.lit(0))))
        text_ = F.array_join(F.transform(F.split("protected", pattern), lambda x, i: F.when(i < F.size("_m"), F.concat(x, token(i))).otherwise(x)), "")
        spans = F.concat("spans", F.transform("_m", lambda v, i: F.struct(token(i).alias("token"), v.alias("value"))))
        hit = F.coalesce(F.size("_m"), F.lit(0)) > 0
        done = found.withColumns({"protected": F.when(hit, text_).otherwise(F.col("protected")), "spans": F.when(hit, spans).otherwise(F.col("spans"))}).select(*names)
    return done


def span_counts(text: Column) -> dict[str, Column]:
    """Spans by kind, natively: each pass counts what the passes before it left."""
    counts: dict[str, Column] = {}
    for kind, p in _PASSES:
        counts[kind] = counts.get(kind, F.lit(0)) + F.regexp_count(text, F.lit(p))
        text = F.regexp_replace(text, p, f"⟦{kind}⟧")
    return counts


def _bound(value: Column, make) -> Column:
    """``make`` of the value, which is computed once: inside, lambda variables are values, other expressions are repeated for each element."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def _cut(text: Column, spans: Column | None = None) -> Column:
    """struct(parts, tokens, spans) of a text cut at its tokens."""
    pieces = [F.split(text, TOKEN).alias("parts"), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("tokens")]
    return F.struct(*pieces, *([] if spans is None else [spans.alias("spans")]))


def _span_of(token: Column, spans: Column, before: Column | None = None) -> Column:
    """The span of a token, found by the token's number (``before`` a place, if given); null for tokens of other texts."""
    number = F.regexp_extract(token, r"_([0-9]+)", 1).try_cast("int")
    span = F.when(number < (F.size(spans) if before is None else before), F.get(spans, number))
    return F.when(F.coalesce(span["token"] == token, F.lit(False)), span)


def _filled(cut: Column, spans: Column, before: Column | None = None) -> Column:
    """The cut text with the spans' values for its tokens, joined from one list of pieces."""
    value = lambda token: F.coalesce(_span_of(token, spans, before)["value"], token, F.lit(""))
    return F.array_join(F.zip_with(cut["parts"], cut["tokens"], lambda part, token: F.concat(F.coalesce(part, F.lit("")), value(token))), "")


def _forest(spans: Column) -> Column:
    """Spans (token, value, inner) with the spans inside their values put back, inner being the tokens of these.

    Every round fills all values from those of the round before, until none changes. A value holds tokens of earlier passes only,
    so there are fewer rounds than passes; a token that isn't older than its span is text.
    """
    cut = F.transform(spans, lambda s: F.struct(s["token"].alias("token"), s["value"].alias("value"), _cut(s["value"]).alias("cut")))
    leaf = lambda p: F.struct(p["token"].alias("token"), p["value"].alias("value"), p["cut"]["tokens"].alias("inner"))

    def grown(p: Column, i: Column, trees: Column) -> Column:
        below = F.flatten(F.transform(p["cut"]["tokens"], lambda t: F.coalesce(_span_of(t, trees, i)["inner"], F.array().cast("array<string>"))))
        return F.when(F.size(p["cut"]["tokens"]) == 0, leaf(p)).otherwise(F.struct(p["token"].alias("token"), _filled(p["cut"], trees, i).alias("value"), F.array_distinct(F.concat(p["cut"]["tokens"], below)).alias("inner")))

    def trees(cuts: Column) -> Column:
        def step(acc: Column, _: Column) -> Column:
            new = lambda now: F.struct(now.alias("trees"), (now == acc["trees"]).alias("done"))
            return F.when(acc["done"], acc).otherwise(_bound(F.transform(cuts, lambda p, i: grown(p, i, acc["trees"])), new))

        flat = F.forall(cuts, lambda p: F.size(p["cut"]["tokens"]) == 0)
        rounds = F.sequence(F.lit(1), F.lit(len(SPANS) - 1))
        return F.aggregate(rounds, F.struct(F.transform(cuts, leaf).alias("trees"), flat.alias("done")), step)["trees"]

    return _bound(cut, trees)


def restore(translated: Column, spans: Column, nested: bool = False) -> Column:
    """struct(text, lost): spans put back, lost is the first token that isn't there (text is then null).

    The text is cut at its tokens once, and a token's number finds its value. ``nested`` also restores spans inside spans, from a
    forest in which each span's value is filled from those it holds; tokens are then missed from the last to the first.
    """

    def answer(c: Column) -> Column:
        there = F.flatten(F.transform(c["tokens"], lambda t: F.concat(F.array(t), F.coalesce(_span_of(t, c["spans"])["inner"], F.array().cast("array<string>"))))) if nested else c["tokens"]
        missing = F.array_except(F.transform(F.reverse(c["spans"]) if nested else c["spans"], lambda s: s["token"]), there)
        lost = lambda gone: F.struct(F.when(gone.isNull(), fx.js_trim(_filled(c, c["spans"]))).alias("text"), gone.alias("lost"))
        return _bound(F.get(missing, F.lit(0)), lost)

    return F.when(translated.isNull() | spans.isNull(), F.lit(None)).otherwise(_bound(_cut(translated, _forest(spans) if nested else spans), answer))


def parse_ids(outputs: DataFrame) -> DataFrame:
    """request_id, id, translation from (request_id, output): a line @@id opens a body; blank bodies go, the last of an id wins."""
    lines = outputs.select("request_id", F.posexplode(F.split(F.regexp_replace("output", r"\r\n?", "\n"), "\n")).alias("pos", "line"))
    w = Window.partitionBy("request_id").orderBy("pos")
    marker = F.nullif(F.regexp_extract(fx.js_trim(F.col("line")), r"^@@([A-Za-z0-9_-]+)\z", 1), F.lit(""))
    marked = lines.withColumn("id", marker).withColumn("no", F.count("id").over(w)).where("no > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("id").isNull(), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    bodies = marked.groupBy("request_id", "no").agg(F.max("id").alias("id"), fx.js_trim(body).alias("translation")).where("translation <> ''")
    return bodies.groupBy("request_id", "id").agg(F.max_by("translation", "no").alias("translation"))


def strip_fence(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fx.js_trim(c), r"(?i)^```(?:json)?\s*", ""), r"\s*```\z", "")


def parse_json(outputs: DataFrame) -> DataFrame:
    """request_id, id, translation, failed: non-blank strings of the object "translations"; failed rows have no such object."""
    body = F.try_variant_get(F.try_parse_json(strip_fence(F.col("output"))), "$.translations", "map<string,variant>")
    rows = outputs.select("request_id", body.alias("m"))
    good = rows.where("m is not null").select("request_id", F.explode("m").alias("id", "v")).where(F.schema_of_variant("v") == "STRING")
    texts = good.select("request_id", "id", fx.js_trim(F.variant_get("v", "$", "string")).alias("translation"), F.lit(False).alias("failed")).where("translation <> ''")
    return texts.unionByName(rows.where("m is null").select("request_id", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("translation"), F.lit(True).alias("failed")))


def parse_terms(output: Column, most: int = 30) -> Column:
    """Generated glossary: non-blank en/zh pairs of {"terms": [...]}, trimmed, the first ``most``."""
    items = F.from_json(strip_fence(output), "terms array<struct<en:string,zh:string>>")["terms"]
    clean = F.transform(items, lambda t: F.struct(fx.js_trim(t["en"]).alias("term"), fx.js_trim(t["zh"]).alias("translation")))
    return F.slice(F.filter(F.coalesce(clean, F.array().cast("array<struct<term:string,translation:string>>")), lambda t: (t["term"] != "") & (t["translation"] != "")), 1, most)


def repair_translations(blocks: DataFrame) -> DataFrame:
    """Sanitized translations and whether each changed."""
    clean = fx.sanitize(F.col("translation"))
    return blocks.withColumn("_c", clean).withColumn("changed", F.coalesce(F.col("_c") != F.col("translation"), F.lit(False))).withColumn("translation", F.col("_c")).drop("_c")


def clear_connectors(blocks: DataFrame, language: Column) -> DataFrame:
    """Translations with an untranslated connector go back to pending; cleared says which."""
    bad = F.coalesce(fx.has_untranslated_connector(F.col("translation"), language), F.lit(False))
    return blocks.withColumn("cleared", bad).withColumn("translation", F.when(~F.col("cleared"), F.col("translation"))).withColumn("status", F.when(F.col("cleared"), "pending").otherwise(F.col("status")))


def planned_blocks(plan: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, batch_no, ord, id, source, error of the batches (doc_id, batch_no, block_ids): an id that no block has is an error."""
    places = plan.select("doc_id", "batch_no", F.posexplode("block_ids").alias("ord", "id"))
    known = blocks.select("doc_id", "id", "source", F.lit(True).alias("_known"))
    error = F.when(F.col("_known").isNull(), F.concat(F.lit("unknown block "), F.col("id")))
    return places.join(known, ["doc_id", "id"], "left").select("doc_id", "batch_no", "ord", "id", "source", error.alias("error"))


def accept(blocks: DataFrame, answers: DataFrame, language: Column | None = None) -> DataFrame:
    """Blocks with the answer of their id, judged (see :func:`judge`)."""
    refused = F.col("error") if "error" in answers.columns else F.lit(None).cast("string")
    joined = blocks.drop("translation", "status", "error").join(answers.select("doc_id", "id", F.col("translation").alias("answer"), refused.alias("refused")), ["doc_id", "id"], "left")
    return judge(joined, language)


def judge(rows: DataFrame, language: Column | None = None) -> DataFrame:
    """translation, status and error of (answer, refused, spans): sanitized and restored, or failed with a reason (the answer's own
    error, missing, marker, lost token, connector)."""
    language = F.lit("en") if language is None else language
    back = rows.withColumn("clean", fx.sanitize(F.col("answer"))).withColumn("r", restore(F.col("clean"), F.col("spans")))
    text = F.col("r.text")
    error = (
        F.when(fx.blank_to_null(F.col("answer")).isNull(), F.coalesce("refused", F.lit("missing"))).when((F.col("clean") == "") | fx.leaks_protocol(F.col("clean")), "protocol marker")
        .when(F.col("r.lost").isNotNull(), F.concat(F.lit("lost "), F.col("r.lost"))).when(fx.leaks_protocol(text), "protocol marker")
        .when(fx.has_untranslated_connector(text, language), "untranslated connector")
    )
    judged = back.withColumn("error", error).withColumn("translation", F.when(F.col("error").isNull(), text))
    return judged.withColumn("status", F.when(F.col("error").isNull(), "translated").otherwise("failed")).drop("r", "answer", "clean", "refused")
