"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are lower-cased runs of ASCII letters, digits and non-ASCII bytes. Features are single words, their stems
(first bytes), neighbouring pairs and pairs with one word between, hashed to 2**24 places; a text has a feature or not. Per-coordinate learning rates and
L1 sparsity leave a short list of non-zero weights, which travels with the scoring stage.

Defined results: null, empty and wordless texts score by the bias alone; without usable labels the score is 0.5; a
score at the threshold is predicted 1; repeated rows score alike, and as a labelled document they are learnt from once,
by their least text; very long texts are scored whole (in one piece, memory in proportion to the text) but not learnt
from; an empty table gives an empty result; other columns pass through, and those named score or predicted give way to
the new ones (:func:`without_toxic` keeps all).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import append_columns, held_out, label_sample, table, text_chunks
from quire.llm.hashing import FOLDED, WORD_BYTES, U, mix, prefix, ranges, word_spans

BITS = 24
#: Bounded training sample: rows at most, characters of a row at most.
SAMPLE_ROWS, SAMPLE_CHARS = 6000, 200_000
#: A word longer than these many bytes also counts by its first bytes, so inflected forms share a feature.
STEMS = (3, 4, 5, 6, 7, 8)
#: Rates of learning, and L1 for the square root of the number of rows: what inner splits of the rows learnt from did best with.
ALPHA, SPARSITY = 4.0, 0.19
FOLDS, FOLD = 3, 1
THRESHOLD = 0.7


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hashed place of every n-gram and skip-gram, repeats included."""
    starts, ends = word_spans(buf, offs, WORD_BYTES)
    sums = prefix(buf, FOLDED)
    words, at = ranges(sums, starts, ends), np.searchsorted(starts, offs)
    own = np.repeat(np.arange(len(at) - 1), np.diff(at))
    texts, places = [own], [words * U(0x2545F4914F6CDD1D)]
    for stem in STEMS:
        long = ends - starts > stem
        texts.append(own[long])
        places.append(ranges(sums, starts[long], starts[long] + stem) * U(0xDA942042E4DD58B5 + 2 * stem))
    for gap, salt in ((1, 0x9E6C63D0876A9A47), (2, 0xC2B2AE3D27D4EB4F)):
        same = own[:-gap] == own[gap:]
        texts.append(own[:-gap][same])
        places.append(mix(words[:-gap] * U(salt) + words[gap:])[same])
    shift = U(64 - BITS)
    return np.concatenate(texts), np.concatenate([p >> shift for p in places]).astype(np.int64)


@dataclass
class Model:
    """Sorted places of the non-zero weights, the weights, the bias."""

    places: np.ndarray
    weights: np.ndarray
    bias: float

    def scorer(self):
        coarse = np.zeros(1 << 16, bool)
        coarse[self.places >> (BITS - 16)] = True

        def score(column: pa.Array) -> np.ndarray:
            out = np.full(len(column), self.bias)
            for lo, hi, buf, offs in text_chunks(column):
                texts, places = features(buf, offs)
                if not len(self.places):
                    continue
                near = coarse[places >> (BITS - 16)]
                texts, places = texts[near], places[near]
                found = np.minimum(np.searchsorted(self.places, places), len(self.places) - 1)
                hit = self.places[found] == places
                pairs = np.unique(texts[hit] * len(self.places) + found[hit])
                out[lo:hi] += np.bincount(pairs // len(self.places), self.weights[pairs % len(self.places)], hi - lo)
            return 1.0 / (1.0 + np.exp(-np.clip(out, -35, 35)))

        return score


def fit(rows: list[tuple[np.ndarray, int]], alpha: float = ALPHA, beta: float = 1.0, l1: float | None = None, l2: float = 0.01, epochs: int = 10) -> Model:
    """FTRL-proximal passes over (distinct places, label) rows in the given order; chance sums grow with the root of their number, so does L1."""
    if not rows:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    l1 = SPARSITY * len(rows) ** 0.5 if l1 is None else l1
    z, n = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
    bias = grad2 = 0.0

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        return np.where(np.abs(own) <= l1, 0.0, (np.sign(own) * l1 - own) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for at, y in rows:
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
            seen = n[at]
            z[at] += g - (np.sqrt(seen + g * g) - np.sqrt(seen)) / alpha * w
            n[at] = seen + g * g
            grad2 += g * g
            bias -= alpha / (beta + np.sqrt(grad2)) * g
    live = np.flatnonzero(np.abs(z) > l1)
    w = weights(live)
    return Model(live, w.astype(float), float(bias))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from a bounded sample of labelled rows outside the held-out fold; features are made on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in text_chunks(batch.column(1)):
                texts, places = features(buf, offs)
                pairs = np.unique((texts << BITS) | places)
                ends = np.searchsorted(pairs >> BITS, np.arange(hi - lo + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((pairs & ((1 << BITS) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), lists], ["k", "y", "f"])

    sample = label_sample(docs, labels, "toxic", FOLDS, FOLD, SAMPLE_ROWS, SAMPLE_CHARS).select(F.xxhash64("doc_id").alias("k"), "text", "_y")
    got = sample.mapInArrow(run, "k bigint, y int, f array<int>").toArrow()
    order = np.argsort(got["k"].to_numpy(), kind="stable")
    lists, y = got["f"].combine_chunks(), got["y"].to_numpy()
    if not len(order):
        return fit([])
    flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    return fit([(flat[ends[i] : ends[i + 1]], int(y[i])) for i in order])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with columns score and predicted."""

    def make():
        score = model.scorer()

        def work(column: pa.Array) -> list[pa.Array]:
            s = score(column)
            return [pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))]

        return work

    return append_columns(docs, "text", make, "score double, predicted int")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model does not find toxic, with all their columns."""
    names = docs.columns
    inner = [f"q{i}" if n != "text" else "text" for i, n in enumerate(names)]
    return score_documents(docs.toDF(*inner), model).where("predicted = 0").select(*inner).toDF(*names)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", "predicted")
