"""Quality classifier: a sparse rule ensemble over text statistics.

``measure`` computes statistics of whole texts.  Boosted depth-3 trees on random halves of a
bounded labelled sample yield paths; each path is a conjunctive rule (``caps > 0.4 AND words
<= 80``).  A lasso logistic fit keeps few rules, and ``compile_rules`` turns them into one
Spark column expression, so scoring stays in the plan.

At most ``SAMPLE`` labelled rows, those with the least hash of the id, are fitted.  Empty and null texts have zero
statistics and a score like any other text.  Repeated rows count and are scored each.
Without two classes among the labels the score is their share (0.5 without labels).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.arrays import count_rows, runs, utf8, words
from wardline.llm.registry import query
from wardline.llm.tables import fold, scalar, table, with_label

SAMPLE = 20_000
STATS = ["n_bytes", "n_words", "word_bytes", "caps", "digits", "symbols", "marks", "symbol_runs", "pipes", "lines", "blanks", "high", "repeats", "distinct"]
_CODE = np.arange(256)
_UPPER = (_CODE >= 65) & (_CODE <= 90)
_LETTER = _UPPER | ((_CODE >= 97) & (_CODE <= 122)) | (_CODE >= 128)
_DIGIT = (_CODE >= 48) & (_CODE <= 57)
_BLANK = (_CODE <= 32)
_SYMBOL = (_CODE < 128) & ~_LETTER & ~_DIGIT & ~_BLANK
_MARK = np.isin(_CODE, [*map(ord, ".,;:'\"-()")])


def measure(text: pa.Array) -> dict[str, np.ndarray]:
    """Statistics of each row, as float arrays by name."""
    data, offsets = utf8(text)
    n, size = len(offsets) - 1, np.diff(offsets).astype(float)

    def share(flag: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(flag[data], out=total[1:])
        return np.diff(total[offsets]) / np.maximum(of, 1)

    row, word = words(data, offsets)
    n_words = count_rows(row, n).astype(float)
    same = (row[1:] == row[:-1]) & (word[1:] == word[:-1])
    near = (row[2:] == row[:-2]) & (word[2:] == word[:-2])
    repeats = count_rows(row[1:][same], n) + count_rows(row[2:][near], n)
    packed = np.sort((row.astype(np.uint64) << np.uint64(40)) | (word >> np.uint64(24)))
    fresh = packed[np.r_[True, packed[1:] != packed[:-1]]] if len(packed) else packed
    distinct = count_rows((fresh >> np.uint64(40)).astype(np.int64), n)
    symbol = _SYMBOL[data] & ~_MARK[data]
    start, end = runs(symbol, offsets)
    long = start[end - start >= 2]
    letters = share(_LETTER, np.ones(n))
    return {
        "n_bytes": size, "n_words": n_words, "word_bytes": letters / np.maximum(n_words, 1), "caps": share(_UPPER, letters),
        "digits": share(_DIGIT, size), "symbols": share(_SYMBOL & ~_MARK, size), "marks": share(_MARK, n_words),
        "symbol_runs": count_rows(np.searchsorted(offsets, long, side="right") - 1, n) / np.maximum(n_words, 1),
        "pipes": share(_CODE == 124, n_words), "lines": share(_CODE == 10, n_words), "blanks": share(_BLANK, size), "high": share(_CODE >= 128, size),
        "repeats": repeats / np.maximum(n_words, 1), "distinct": distinct / np.maximum(n_words, 1),
    }


def _struct(text: pa.Array) -> pa.Array:
    m = measure(text)
    return pa.StructArray.from_arrays([pa.array(np.asarray(m[s], dtype=np.float64)) for s in STATS], STATS)


def with_stats(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_stats", scalar(_struct, ", ".join(f"{s} double" for s in STATS))(F.col("text")))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, greater, threshold)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for j, greater, cut in rule:
        out &= (x[:, j] > cut) if greater else (x[:, j] <= cut)
    return out


def tree_paths(x: np.ndarray, target: np.ndarray, rng: np.random.Generator, depth: int = 3, least: int = 20, cuts: int = 31) -> tuple[list[Rule], np.ndarray]:
    """Paths to all nodes of a least-squares tree, and its fitted values."""
    fitted, paths = np.full(len(x), target.mean() if len(x) else 0.0), []
    todo = [((), np.arange(len(x)))]
    while todo:
        path, at = todo.pop()
        best = (1e-9, None)
        if len(path) < depth and len(at) >= 2 * least:
            y = target[at] - target[at].mean()
            for j in rng.permutation(x.shape[1])[: max(4, x.shape[1] // 2)]:
                v = x[at, j]
                for cut in np.unique(np.quantile(v, np.linspace(0, 1, cuts + 2)[1:-1])):
                    right = v > cut
                    k = int(right.sum())
                    if least <= k <= len(at) - least:
                        gain = y[right].sum() ** 2 / k + y[~right].sum() ** 2 / (len(at) - k)
                        if gain > best[0]:
                            best = (gain, (int(j), float(cut), right))
        if best[1] is None:
            fitted[at] = target[at].mean()
            continue
        j, cut, right = best[1]
        for greater, part in ((False, at[~right]), (True, at[right])):
            below = (*path, (j, greater, cut))
            paths.append(below)
            todo.append((below, part))
    return paths, fitted


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient; the intercept is free."""
    n, k = r.shape
    centre = r.mean(0)
    a = r - centre
    rate = 4 * n / (np.linalg.norm(a, 2) ** 2 + n)
    w, b = np.zeros(k), math.log(y.mean() / (1 - y.mean()))
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ v + c, -30, 30)))
        g = a.T @ (p - y) / n
        nw = v - rate * g
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nb = c - rate * (p - y).mean()
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return b - float(centre @ w), w


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, penalty: float = 0.001, seed: int = 7) -> tuple[float, list[tuple[Rule, float]]]:
    """(intercept, weighted rules)."""
    if len(y) == 0 or y.min() == y.max():
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        return math.log(share / (1 - share)), []
    rng = np.random.default_rng(seed)
    rules: dict[Rule, None] = {}
    raw = np.zeros(len(y))
    for _ in range(trees):
        part = rng.permutation(len(y))[: max(50, min(4000, len(y) // 2))]
        residual = y - 1 / (1 + np.exp(-raw))
        paths, _ = tree_paths(x[part], residual[part], rng)
        rules.update(dict.fromkeys(paths))
        leaf = [p for p in paths if not any(q[: len(p)] == p and len(q) > len(p) for q in paths)]
        for p in leaf:
            inside = holds(p, x)
            h = (1 / (1 + np.exp(-raw[inside])))
            if inside.any():
                raw[inside] += 0.3 * residual[inside].sum() / max((h * (1 - h)).sum(), 1e-3)
        raw = np.clip(raw, -8, 8)
    names = list(rules)
    r = np.stack([holds(p, x) for p in names], axis=1).astype(float) if names else np.zeros((len(y), 0))
    if r.shape[1] == 0:
        return math.log(y.mean() / (1 - y.mean())), []
    _, keep = np.unique(r, axis=1, return_index=True)
    keep = np.sort(keep)
    b, w = lasso_logistic(r[:, keep], y, penalty)
    return b, [(names[i], float(v)) for i, v in zip(keep, w) if abs(v) > 1e-6]


def compile_rules(intercept: float, rules: list[tuple[Rule, float]], stats: str = "_stats") -> Column:
    """The score as one column expression over the statistics."""
    z = F.lit(float(intercept))
    for rule, weight in rules:
        cond = F.lit(True)
        for j, greater, cut in rule:
            s = F.col(f"{stats}.{STATS[j]}")
            cond = cond & ((s > F.lit(cut)) if greater else (s <= F.lit(cut)))
        z = z + F.when(cond, F.lit(weight)).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> tuple[float, list[tuple[Rule, float]]]:
    """Fit on labelled rows outside the held-out fold (crc32 of doc_id modulo 4 is 2)."""
    known = with_label(docs.where(fold(F.col("doc_id"), 4) != 2).select("doc_id", "text"), labels, label).where("y IS NOT NULL")
    picked = with_stats(known).select("y", "_stats", F.xxhash64("doc_id").alias("h"), "doc_id").orderBy("h", "doc_id").limit(sample).select("y", "_stats.*").toPandas()
    return fit(picked[STATS].to_numpy(float), picked["y"].to_numpy(float))


def score(docs: DataFrame, model: tuple[float, list[tuple[Rule, float]]]) -> DataFrame:
    """``docs`` with the column ``score``."""
    return with_stats(docs).withColumn("score", compile_rules(*model)).drop("_stats")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows that the classifier, trained on their labelled part, rejects."""
    model = train(docs, labels)
    rows = docs.select("text", F.struct("*").alias("row"))
    return score(rows, model).where(F.col("score") >= threshold).select("row.*")


@query("op2_rule_ensemble")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
