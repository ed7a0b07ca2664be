"""Quality classifier: a sparse rule ensemble over text statistics.

Shallow trees grown on a bounded labelled sample give conjunctive rules (one for each tree path), a lasso logistic
regression weighs them, and the surviving rules become one Spark column expression, so scoring is a single native
projection over whole texts.

Defined results: null and empty texts have all statistics 0 and score by their rules; without usable labels every
score is 0.5; with one class or too few rows to split, the score is the smoothed share of good rows; a score at the
threshold is predicted 1; repeated rows score alike, and as a labelled document they are learnt from once, by their least
text; very long texts are scored whole but not learnt from; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import held_out, label_sample, table

#: Bounded training sample: rows at most, characters of a row at most.
SAMPLE_ROWS, SAMPLE_CHARS = 8000, 200_000
FOLDS, FOLD = 5, 0
THRESHOLD = 0.3


def statistics(text: Column) -> dict[str, Column]:
    """Raw counts of a text; each is a native expression evaluated once."""
    t = F.coalesce(text, F.lit(""))
    return {
        "chars": F.length(t),
        "words": F.regexp_count(t, F.lit(r"[^ \t-\r]+")),
        "upper": F.regexp_count(t, F.lit(r"\p{Lu}")),
        "digits": F.regexp_count(t, F.lit(r"[0-9]")),
        "symbols": F.regexp_count(t, F.lit(r"[#$%&*|!?~^<>{}=+@_\[\]\\/]")),
        "stops": F.regexp_count(t, F.lit(r"[.,;:]")),
        "doubled": F.regexp_count(t, F.lit(r"(?<![^ \n])([^ \n]++)(?=[ \n]\1(?![^ \n]))")),
        "distinct": F.size(F.array_distinct(F.split(F.lower(t), r"[ \t-\r]+"))),
        "lines": F.size(F.split(t, "\n")),
        "distinct_lines": F.size(F.array_distinct(F.split(t, "\n"))),
    }


def ratios() -> dict[str, Column]:
    """Learning features made from the counts."""
    c = F.col
    per = lambda a, b: c(f"_{a}") / F.greatest(c(f"_{b}"), F.lit(1))
    return {
        "chars": c("_chars").cast("double"), "words": c("_words").cast("double"), "word_length": per("chars", "words"), "upper": per("upper", "chars"),
        "digits": per("digits", "chars"), "symbols": per("symbols", "words"), "stops": per("stops", "words"), "doubled": per("doubled", "words"),
        "distinct": per("distinct", "words"), "line_words": per("words", "lines"), "distinct_lines": per("distinct_lines", "lines"),
    }


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id and features (and any other column but the text), named f_*."""
    keep = [c for c in docs.columns if c != "text"]
    # a generator's output isn't inlined into later projections or filters, so every count is made once a text
    counted = docs.select(*keep, F.inline(F.array(F.struct(*[v.alias(f"_{k}") for k, v in statistics(F.col("text")).items()]))))
    return counted.select(*keep, *[v.alias(f"f_{k}") for k, v in ratios().items()])


Rule = tuple[tuple[str, bool, float], ...]


@dataclass
class Rules:
    """Weighted conjunctions of (feature, is above, threshold) and the intercept."""

    rules: list[tuple[Rule, float]] = field(default_factory=list)
    intercept: float = 0.0

    def column(self) -> Column:
        """The ensemble compiled to one column expression over the f_* columns."""
        total = F.lit(float(self.intercept))
        for rule, w in self.rules:
            cond = F.lit(True)
            for name, above, cut in rule:
                c = F.col(f"f_{name}")
                cond = cond & (c > cut if above else c <= cut)
            total = total + F.when(cond, F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(rule: Rule, names: list[str], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, above, cut in rule:
        c = x[:, names.index(name)]
        out &= c > cut if above else c <= cut
    return out


def tree_paths(x: np.ndarray, y: np.ndarray, names: list[str], rng: np.random.Generator, depth: int = 3, least: int = 10) -> list[Rule]:
    """Paths to all nodes of one tree, grown on a bootstrap with a random part of the features."""
    rows = rng.integers(0, len(x), len(x))
    chosen = rng.permutation(len(names))[: max(3, int(len(names) * 0.6))]
    out: list[Rule] = []

    def grow(at: np.ndarray, path: Rule) -> None:
        if path:
            out.append(path)
        n, k = len(at), y[at].sum()
        if len(path) == depth or n < 2 * least or k in (0, n):
            return
        best = (1e-9, None, 0.0)
        for f in chosen:
            values = x[at, f]
            for cut in np.unique(np.quantile(values, np.linspace(0.02, 0.98, 25))):
                low = values <= cut
                nl = int(low.sum())
                if least <= nl <= n - least:
                    kl = y[at][low].sum()
                    gain = k * (n - k) / n - kl * (nl - kl) / nl - (k - kl) * (n - nl - k + kl) / (n - nl)
                    if gain > best[0]:
                        best = (gain, f, float(cut))
        if best[1] is not None:
            low = x[at, best[1]] <= best[2]
            for above, part in ((False, at[low]), (True, at[~low])):
                grow(part, (*path, (names[best[1]], above, best[2])))

    grow(rows, ())
    return out


def lasso(m: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for the L1-penalised logistic loss; the intercept isn't penalised."""
    n = len(y)
    mean = m.mean(0)
    scale = np.sqrt(mean * (1 - mean)) + 1e-3
    z = (m - mean) / scale
    share = np.clip(y.mean(), 1 / (n + 2), 1 - 1 / (n + 2))
    w, b = np.zeros(m.shape[1]), float(np.log(share / (1 - share)))
    top = np.linalg.norm(z, 2) ** 2 / (4 * n) + 0.25
    v, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(z @ v + vb, -35, 35))) - y
        new = v - z.T @ r / n / top
        new = np.sign(new) * np.maximum(np.abs(new) - penalty / top, 0)
        nb = vb - r.mean() / top
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return w / scale, b - float((w / scale * mean).sum())


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 24, penalty: float = 0.002, seed: int = 7) -> Rules:
    if not len(y):
        return Rules()
    rng = np.random.default_rng(seed)
    rules = sorted({r for _ in range(trees) for r in tree_paths(x, y, names, rng)}) if y.min() < y.max() else []
    if not rules:
        share = (y.sum() + 1) / (len(y) + 2)
        return Rules([], float(np.log(share / (1 - share))))
    m = np.array([holds(r, names, x) for r in rules], float).T
    _, first = np.unique(m, axis=1, return_index=True)  # rules that hold for the same rows
    first = np.sort(first)
    w, b = lasso(m[:, first], y, penalty)
    return Rules([(rules[i], float(c)) for i, c in zip(first, w) if abs(c) > 1e-6], b)


def train(docs: DataFrame, labels: DataFrame) -> Rules:
    """Rules from a bounded sample of labelled rows outside the held-out fold (one row of statistics each)."""
    got = with_features(label_sample(docs, labels, "quality", FOLDS, FOLD, SAMPLE_ROWS, SAMPLE_CHARS)).toPandas()
    got = got.sort_values([c for c in got.columns if c.startswith("f_")] + ["_y"], kind="stable")
    names = list(ratios())
    return fit(got[[f"f_{n}" for n in names]].to_numpy(float), got["_y"].to_numpy(float), names)


def score_documents(docs: DataFrame, rules: Rules) -> DataFrame:
    """doc_id, score and predicted of every text."""
    scored = with_features(docs.select("doc_id", "text")).select("doc_id", rules.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", "predicted")
