"""Quality by a sparse ensemble of rules.

Small boosted trees over a few statistics of a text give conjunctive rules (every path from a root), a logistic
model with a lasso penalty weights them, most weights become zero, and the rest is compiled into one Spark column
expression. Only the fit is in numpy, on a bounded sample of labelled rows; scoring stays in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_of

#: The most labelled rows that a fit takes (those of least hash); it bounds what is broadcast and collected.
SAMPLE = 20_000
TREES, DEPTH, BINS, LEAST_LEAF, SHRINK = 40, 3, 32, 20, 0.3
PENALTY, STEPS = 0.002, 400

STATS = ("n_words", "mean_word", "symbol_share", "upper_share", "digit_share", "mark_share", "distinct_share", "dup_line_share", "line_words", "exclaim_share", "top_share")


def stats(docs: DataFrame) -> DataFrame:
    """doc_id and STATS (doubles) of each row; null text is empty, and what would be 0 / 0 is 0."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(text).alias("w"), lines.alias("l"))
    rows = rows.select("doc_id", "w", F.concat_ws("", "w").alias("c"), F.size("l").alias("n_l"), F.size(F.array_distinct("l")).alias("n_dl"))
    left = lambda pattern: F.length(F.regexp_replace("c", pattern, ""))
    rows = rows.select(
        "doc_id", "n_l", "n_dl", F.size("w").alias("n_w"), F.size(F.array_distinct("w")).alias("n_dw"), F.length("c").alias("n_c"),
        left(r"[#*$%&|<>]").alias("c_sym"), left(r"\p{Lu}").alias("c_up"), left("[0-9]").alias("c_dig"), left(r"[\p{L}\p{N}]+").alias("c_mark"), left("!").alias("c_ex"),
        # the share of the text's first, middle and last word: of texts that repeat a few words it is large
        F.size(F.array_remove(F.array_remove(F.array_remove("w", F.get("w", F.lit(0))), F.get("w", (F.size("w") / 2).cast("int"))), F.element_at(F.when(F.size("w") > 0, F.col("w")), -1))).alias("n_rest"),
    )
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0)).cast("double")
    n_w, n_c, n_l = F.col("n_w"), F.col("n_c"), F.col("n_l")
    return rows.select(
        "doc_id", n_w.cast("double").alias("n_words"), share(n_c, n_w).alias("mean_word"), share(n_c - F.col("c_sym"), n_c).alias("symbol_share"), share(n_c - F.col("c_up"), n_c).alias("upper_share"),
        share(n_c - F.col("c_dig"), n_c).alias("digit_share"), share(F.col("c_mark"), n_c).alias("mark_share"), share(F.col("n_dw"), n_w).alias("distinct_share"), share(n_l - F.col("n_dl"), n_l).alias("dup_line_share"),
        share(n_w, n_l).alias("line_words"), share(n_c - F.col("c_ex"), n_c).alias("exclaim_share"), F.coalesce(share(n_w - F.col("n_rest"), n_w), F.lit(0.0)).alias("top_share"),
    )


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold): value > threshold, or value <= threshold


def _grow(bins: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rng: np.random.Generator) -> tuple[list[Rule], np.ndarray]:
    """One regression tree on the logistic gradient: its rules (every node but the root) and its predictions."""
    rules, out = [], np.zeros(len(grad))
    todo: list[tuple[np.ndarray, Rule]] = [(np.arange(len(grad)), ())]
    some = rng.permutation(bins.shape[1])[: max(3, bins.shape[1] * 2 // 3)]
    while todo:
        at, path = todo.pop()
        if path:
            rules.append(path)
        g, h = grad[at], hess[at]
        best = (1e-6, -1, -1)
        if len(path) < DEPTH and len(at) >= 2 * LEAST_LEAF:
            base = g.sum() ** 2 / (h.sum() + 1)
            for j in sorted(some.tolist()):
                size = len(cuts[j]) + 1
                b = bins[at, j]
                n, sg, sh = (np.cumsum(np.bincount(b, weights=x, minlength=size))[:-1] for x in (np.ones(len(at)), g, h))
                if not len(n):
                    continue
                gain = sg**2 / (sh + 1) + (g.sum() - sg) ** 2 / (h.sum() - sh + 1) - base
                gain[(n < LEAST_LEAF) | (len(at) - n < LEAST_LEAF)] = -1
                if gain.max() > best[0]:
                    best = (gain.max(), j, int(gain.argmax()))
        if best[1] < 0:
            out[at] = g.sum() / (h.sum() + 1)
            continue
        _, j, k = best
        low = bins[at, j] <= k
        todo += [(at[low], (*path, (j, False, float(cuts[j][k])))), (at[~low], (*path, (j, True, float(cuts[j][k]))))]
    return rules, out


def _plain(rule: Rule) -> Rule:
    """One condition for each statistic and direction, the strictest, in order."""
    held: dict[tuple[int, bool], float] = {}
    for j, above, t in rule:
        held[j, above] = t if (j, above) not in held else max(held[j, above], t) if above else min(held[j, above], t)
    return tuple((j, above, t) for (j, above), t in sorted(held.items()))


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for j, above, t in rule:
        out &= (x[:, j] > t) == above
    return out


@dataclass
class RuleModel:
    intercept: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, w in zip(self.rules, self.weights, strict=True):
            z += w * _holds(rule, x)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        """The score as an expression over the columns of stats()."""
        z = F.lit(float(self.intercept))
        for rule, w in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for j, above, t in rule:
                holds = holds & (F.col(STATS[j]) > t if above else F.col(STATS[j]) <= t)
            z = z + F.when(holds, F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> RuleModel:
    """x: rows of STATS; y: 0 or 1. Without rows, or with one label only, the smoothed base rate is the score."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = RuleModel(float(np.log(rate / (1 - rate))))
    if len(y) < 2 * LEAST_LEAF or y.min() == y.max():
        return model
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    z = np.full(len(y), model.intercept)
    found: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        rules, step = _grow(bins, cuts, y - p, p * (1 - p), rng)
        found |= dict.fromkeys(map(_plain, rules))
        z += SHRINK * np.clip(step, -4, 4)
    rules = [r for r in found if 0 < _holds(r, x).mean() < 1]
    if not rules:
        return model
    m = np.stack([_holds(r, x) for r in rules], axis=1).astype(np.float64)
    mean, scale = m.mean(0), np.maximum(m.std(0), 0.05)
    m = (m - mean) / scale
    w, v, b, t = np.zeros(len(rules)), np.zeros(len(rules)), model.intercept, 1.0
    rate_of = 4.0 / max(np.linalg.norm(m, 2) ** 2 / len(y), 1e-9)
    for _ in range(STEPS):  # accelerated proximal gradient
        p = 1 / (1 + np.exp(-np.clip(m @ v + b, -30, 30)))
        b += (y - p).mean() * 2
        new = v + rate_of * (m.T @ (y - p)) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate_of * PENALTY, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    on = np.flatnonzero(np.abs(w) > 1e-4)
    return RuleModel(float(b - (w[on] * mean[on] / scale[on]).sum()), [rules[i] for i in on], (w[on] / scale[on]).tolist())


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of doc_id as text, mod folds, is fold; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % folds == fold, F.lit(False))


def label_sample(labels: DataFrame, label: str, held_out: Column, rows: int) -> DataFrame:
    """doc_id and y of at most `rows` labelled documents outside the held-out fold, those of least hash; the greatest label of a doc_id counts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out)
    return known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, rows: int = SAMPLE) -> RuleModel:
    sample = label_sample(labels, "quality", in_fold(F.col("doc_id"), folds, fold), rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    got = stats(chosen.select("doc_id", "text")).join(F.broadcast(sample), "doc_id").orderBy("doc_id", *STATS).toPandas()
    return fit_rules(got[list(STATS)].to_numpy(dtype=np.float64).reshape(-1, len(STATS)), got["y"].to_numpy(dtype=np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (doc_id, text), learnt from labels (doc_id, quality).

    Labels of the held-out fold are not read. Null text is empty and gets the score its statistics give; null
    doc_ids are scored and count as not held out; repeated rows are scored each; other columns are ignored. With
    no usable labels every score is 0.5.
    """
    model = fit_quality(docs, labels, folds, fold)
    scored = stats(docs).select("doc_id", in_fold(F.col("doc_id"), folds, fold).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
