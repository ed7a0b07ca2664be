"""Line deduplication: lines that many documents hold leave all of them but one.

The lines of every text are exploded with their positions and normalised; a key of ``chars`` code points or more travels
as two 64-bit hashes. Documents are counted once for each hash, in two grouped steps that are combined before they
shuffle, so a line that every document holds is one row a task. What reaches ``least`` documents meets the lines again
(the hot side of that join can be split, the other has one row a hash), and the positions lost meet the texts, which
alone are shuffled whole, and only where those positions are too many to broadcast. Only DataFrame functions are used.

A line's key is the line without the characters of ``STRIPPED`` at both ends, A to Z in lower case. The document with
the largest doc_id of those that hold a key keeps all lines of that key; shorter keys are never dropped.

Defined results: a null or empty text is one empty line; rows of one doc_id are one document, and rows without doc_id
are together one that any other outranks; very long texts are lines as any others, and the positions of one text's lost
lines are one array; repeated rows lose and keep the same lines; an empty table gives an empty result; other columns
pass through, but those named n_lines or n_dropped give way to the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import materialize, table

#: Fixed by op12's contract: characters stripped at both ends of a line, code points of a key and documents it is in at least.
STRIPPED, CHARS, LEAST = " \t\n\x0b\x0c\r", 40, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The normalised line; Spark's lower() is right, and much faster than translate(), where all is ASCII."""
    bare = F.btrim(line, F.lit(STRIPPED))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _hashes(*of: Column) -> list[Column]:
    """128 bits of the values, in two columns."""
    return [F.xxhash64(*of), F.xxhash64(F.lit(1), *of)]


def common_lines(lines: DataFrame, least: int) -> DataFrame:
    """h1, h2, keeper (the largest doc_id) of the hashes that ``least`` documents hold; lines are (doc_id, h1, h2)."""
    holders = lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    return holders.groupBy("h1", "h2").agg(F.sum("one").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= least).drop("n")


def drop_common_lines(docs: DataFrame, least: int = LEAST, chars: int = CHARS) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the texts that are left and n_lines (before dropping) and n_dropped."""
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    at = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    row = _hashes(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))
    exploded = docs.select("doc_id", row[0].alias("r1"), row[1].alias("r2"), F.posexplode(at).alias("pos", "line"))
    # a key is no longer than its line, so most lines end here without being normalised
    keyed = exploded.where(F.length("line") >= chars).select("doc_id", "r1", "r2", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= chars)
    hashed = _hashes(F.col("key"))
    lines = materialize(keyed.select("doc_id", "r1", "r2", "pos", hashed[0].alias("h1"), hashed[1].alias("h2")), "lines")
    common = materialize(common_lines(lines, least), "lines-common")
    hit = lines.join(common, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    lost = materialize(hit.groupBy("r1", "r2").agg(F.collect_set("pos").alias("lost")), "lines-lost")

    # columns travel by position, so that names don't clash
    named = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(own)], row[0].alias("r1"), row[1].alias("r2"))
    text = f"c{own.index('text')}"
    met = named.join(lost, ["r1", "r2"], "left").withColumn(text, F.coalesce(F.col(text), F.lit("")))
    # bound once for each text: lambda variables are values, the split isn't repeated for each line
    left = F.transform(F.array(F.split(text, "\n")), lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("lost")), lambda i: F.get(ls, i)), "\n"))
    n_lines = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1
    kept = F.when(F.col("lost").isNull(), F.col(text)).otherwise(F.get(left, F.lit(0)))
    results = [n_lines.cast("bigint").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("bigint").alias("n_dropped")]
    return met.select(*[(kept if c == "text" else F.col(f"c{i}")).alias(c) for i, c in enumerate(own)], *results)


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
