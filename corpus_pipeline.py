"""The corpus pipeline: five stages from raw documents to tokens, each the operator named, each on all its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes each result as Parquet in the shared
folder and hands the reread table on. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import materialize, scratch_scope, table
from quire.llm.bpe import encode_documents
from quire.llm.mixing import mixed_documents
from quire.llm.neardup import near_duplicates
from quire.llm.repeats import without_repeats
from quire.llm.toxicity import train, without_toxic

#: A repeated passage leaves the texts if it has over 50 words. Repeats are found from 200 bytes on, which 51 words of
#: three letters or more on average have (in the tables at hand they have 6.1 to 6.7 bytes with the space).
REPEAT_WORDS, REPEAT_BYTES, REPEAT_GRAM = 51, 200, 50
#: Words of a shingle, per cent of common ones: what near duplicates take unless a contract says otherwise (op4's says 4).
SHINGLE_WORDS, ALIKE_PERCENT = 5, 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled documents at hand, finds toxic are dropped.

    Null and empty texts score by the bias; repeated rows fall together; without labels none is dropped; very long texts
    are scored whole; an empty table stays empty; all columns pass, whatever their names.
    """
    return without_toxic(docs, train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels")))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (the least doc_id) stays; five-word shingles, similarity of 0.8 or more.

    Texts without words are near nothing and stay; very long texts are compared whole. Rows without a doc_id can't be told apart and stay; of rows that
    repeat a doc_id and its text one stays. An empty table stays empty; all columns pass, whatever their names.
    """
    kept = near_duplicates(docs.select("doc_id", "text"), k=SHINGLE_WORDS, percent=ALIKE_PERCENT).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Maximal runs of bytes covered by 200-byte strings that occur elsewhere too leave the texts, if over 50 words begin in them.

    Every occurrence goes, in ties as well; a character cut in part goes whole; n_chars follows the text. Null texts
    become empty, rows whose text goes whole stay with an empty one, repeated rows count as repeats of each other; very
    long texts are cut whole. An empty table stays empty; all columns pass, whatever their names.
    """
    kept = without_repeats(docs, REPEAT_BYTES, REPEAT_GRAM, REPEAT_WORDS)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; ties and repeats by the content of the rows, so reruns agree.

    Texts without words have size 0 and come out once or not at all, as their source's rate says; a null source is a
    source of its own; very long texts weigh what they have; an empty table stays empty; all columns pass, whatever their names.
    """
    return mixed_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of the mix; null texts count as empty, other columns end here;
    repeated rows are encoded each, very long texts piece by piece, an empty table gives an empty result."""
    return encode_documents(docs)


STAGES = [("toxicity", toxicity), ("minhash_dedup", minhash_dedup), ("suffix_dedup", suffix_dedup), ("mixing", mixing), ("bpe", bpe)]

#: The stages' learning, hashing and merges can't be stated in SQL; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage writes besides its result is deleted when the result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch_scope(spark, f"stage-{name}"):
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", scoped=False)
    return docs
