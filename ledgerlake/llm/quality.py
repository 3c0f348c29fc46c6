"""Text quality by a sparse rule ensemble.

Statistics of a text are Spark columns. Small trees are grown on labelled rows, each on a part of them and
on what the trees before left unexplained; every path of a tree is a conjunction of conditions on the
statistics. A lasso logistic regression picks and weighs the rules. The chosen rules become one Spark
column expression, so that scoring is a scan without Python. The fit takes at most `bound` labelled rows
(those with the least hash of their id); scores cover every row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import bucket_of, cut, table

BOUND, TREES, DEPTH, CUTS, L1, ROUNDS = 50_000, 40, 3, 16, 2e-3, 400


def statistics(text) -> dict:
    """name -> column; text must not be null."""
    n = F.greatest(F.char_length(text), F.lit(1))
    words = F.greatest(F.regexp_count(text, F.lit(r"\S+")), F.lit(1))
    lines = F.split(text, "\n")
    tokens = F.split(text, " ")
    part = lambda pattern: F.regexp_count(text, F.lit(pattern)) / n
    return {
        "log_chars": F.log1p(F.char_length(text)),
        "word_length": n / words,
        "letters": part(r"\p{L}"),
        "upper": part(r"\p{Lu}"),
        "digits": part(r"\p{Nd}"),
        "marks": part(r"[!?]"),
        "stops": part(r"[.,;:]"),
        "symbols": part(r"[^\p{L}\p{Nd}\s.,;:!?'\"()-]"),
        "distinct_words": F.size(F.array_distinct(tokens)) / F.size(tokens),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "line_length": F.log1p(n / F.size(lines)),
        "longest_line": F.log1p(F.array_max(F.transform(lines, F.char_length))),
    }


def grow(x: np.ndarray, target: np.ndarray, cuts: list[np.ndarray], depth: int, path=()) -> list[tuple]:
    """Paths of a least-squares tree: tuples of (feature, threshold, above)."""
    out = [path] if path else []
    if depth == 0 or len(target) < 20:
        return out
    best, split = 1e-9, None
    for f, ts in enumerate(cuts):
        at = np.searchsorted(ts, x[:, f], "left")  # at <= i means x <= ts[i]
        n, s = (np.cumsum(np.bincount(at, w, len(ts) + 1))[:-1] for w in (None, target))
        m, r = len(target) - n, target.sum() - s
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((n >= 10) & (m >= 10), s * s / n + r * r / m, -np.inf) - target.sum() ** 2 / len(target)
        if len(ts) and gain.max() > best:
            best, split = gain.max(), (f, float(ts[int(gain.argmax())]))
    if split is None:
        return out
    f, t = split
    low = x[:, f] <= t
    return out + grow(x[low], target[low], cuts, depth - 1, (*path, (f, t, False))) + \
        grow(x[~low], target[~low], cuts, depth - 1, (*path, (f, t, True)))


def covers(x: np.ndarray, rule: tuple) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for f, t, above in rule:
        hit &= (x[:, f] > t) == above
    return hit


def lasso_logistic(r: np.ndarray, y: np.ndarray, l1: float, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient steps."""
    n, k = r.shape
    step = 4 * n / max(1.0, np.linalg.norm(np.c_[np.ones(n), r], 2) ** 2)
    w = z = np.zeros(k + 1)
    t, a = 1.0, np.c_[np.ones(n), r]
    for _ in range(rounds):
        g = a.T @ (1 / (1 + np.exp(-np.clip(a @ z, -30, 30))) - y) / n
        new = z - step * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * l1, 0)
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / u * (new - w), new, u
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, l1: float = L1) -> tuple[float, list[tuple]]:
    """(intercept, [(weight, rule)]) of the rules that the lasso keeps. One class only: no rules."""
    if len(y) == 0:
        return 0.0, []
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    if y.min() == y.max():
        return base, []
    rng = np.random.default_rng(7)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 2)[1:-1])) for f in range(x.shape[1])]
    margin, rules = np.full(len(y), base), {}
    for _ in range(trees):
        some = rng.random(len(y)) < 0.5
        left = y - 1 / (1 + np.exp(-margin))
        paths = grow(x[some], left[some], cuts, depth)
        for p in paths:
            rules.setdefault(tuple(sorted(p)), None)
        for p in (p for p in paths if not any(q[:len(p)] == p and len(q) > len(p) for q in paths)):
            hit = covers(x, p)
            if hit.any():
                margin[hit] += 0.5 * left[hit].sum() / max(1e-9, (np.abs(left[hit]) * (1 - np.abs(left[hit]))).sum() + 1)
    rules = list(rules)
    b, w = lasso_logistic(np.stack([covers(x, p) for p in rules], 1).astype(float), y, l1)
    return b, [(float(v), p) for v, p in zip(w, rules, strict=True) if abs(v) > 1e-9]


def rule_score(intercept: float, rules: list[tuple], names: list[str]):
    """The ensemble as one column over columns of these names."""
    total = F.lit(intercept)
    for weight, rule in rules:
        test = F.lit(True)
        for f, t, above in rule:
            test = test & ((F.col(names[f]) > t) if above else (F.col(names[f]) <= t))
        total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def score_quality(docs: DataFrame, labels: DataFrame, learn_from=None, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", bound: int = BOUND) -> DataFrame:
    """doc_id, score, predicted; one row per input row.

    Null texts count as empty and are scored too. Without labels every score is 0.5; with one class it is
    near that class. Labels that are null or for ids without a document teach nothing; repeated rows teach
    as often as they stand. Other columns are not read."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"))
    stats = statistics(F.col("_t"))
    names = list(stats)
    data = cut(base.select("doc_id", *(c.cast("double").alias(k) for k, c in stats.items())), "statistics")
    lab = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y")).filter("_y IS NOT NULL")
    if learn_from is not None:
        lab = lab.filter(learn_from(F.col("_id")))
    rows = (lab.join(data, F.col("_id") == F.col("doc_id"))
            .orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(bound).select("_y", *names).toArrow())
    x = np.stack([rows.column(c).to_numpy() for c in names], 1) if rows.num_rows else np.empty((0, len(names)))
    intercept, rules = fit_rules(x, rows.column("_y").to_numpy() if rows.num_rows else np.empty(0))
    out = data.withColumn("score", rule_score(intercept, rules, names))
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_quality_classifier(spark, sf_dir):
    def fold(c):
        return F.coalesce(bucket_of(c, 3), F.lit(0))

    out = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn_from=lambda c: fold(c) != 1)
    return out.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", "predicted")
