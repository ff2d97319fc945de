"""Quality by a sparse rule ensemble over text statistics, scored in Spark columns.

statistics() are column expressions over the whole text. On a bounded sample of labelled rows (only their
statistics reach the driver) small boosted trees are grown; every path from a root to a node is one rule, a
conjunction of comparisons; lasso-penalised logistic regression gives most rules the weight 0, and the others
are compiled into one column expression. Labels, lang, source and ids are never inputs.

Null and empty texts have the statistics of an empty text and are scored like any other. Without labelled rows
of both kinds the score is the smoothed share of good ones. Conflicting labels of an id count as good; null ids
have no label. Ties of split quality go to the first statistic and the lowest threshold, so reruns agree. An empty
table gives an empty one; repeated rows are scored one by one."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm._shared import sampled_labels, without

#: Labelled rows used at most; trees, their depth, shrinkage, candidate thresholds of a statistic, rows on either side of a split.
SAMPLE, TREES, DEPTH, SHRINK, BINS, LEAST_ROWS = 20_000, 40, 3, 0.3, 32, 8
#: Penalties to choose from, as shares of the one that leaves no rule.
PENALTIES = (0.1, 0.03, 0.01, 0.003)
STATISTICS = ("chars", "words", "word_length", "upper", "digits", "symbols", "bars", "shouts", "stops", "spaces", "distinct_words", "lines", "distinct_lines", "sentences", "distinct_sentences", "wide")


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with the struct column `stat` (a column of that name gives way), one double for each of STATISTICS; each
    pass over the text is made once."""
    df = without(df, "stat")
    t = F.coalesce(F.col(text), F.lit(""))

    classes = {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": "0123456789", "symbols": "#$%&*@^~<>{}[]\\=_+", "bars": "|", "shouts": "!?", "stops": ".,;:", "spaces": " \t\n"}

    def of_class(name: str) -> Column:
        """How many characters the first of the class stands for, once all have been replaced by it."""
        return F.length("folded__") - F.length(F.replace("folded__", F.lit(classes[name][0]), F.lit("")))

    def parts(pattern: str) -> Column:
        return F.array_remove(F.split("text__", pattern), "")

    step = df.select(F.struct(*[f"`{c}`" for c in df.columns]).alias("kept__"), t.alias("text__"))
    step = step.withColumn("folded__", F.translate("text__", "".join(classes.values()), "".join(c[0] * len(c) for c in classes.values())))
    step = step.withColumns({
        "n__": F.length("text__"), "bytes__": F.octet_length("text__"), **{f"{name}__": of_class(name) for name in classes},
        "words__": parts("[ \\t-\\r]+"), "lines__": parts("\n"), "sentences__": parts("[.!?\n] *"),
    })
    step = step.withColumns({f"{x}_all__": F.size(f"{x}__") for x in ("words", "lines", "sentences")} | {f"{x}_own__": F.size(F.array_distinct(f"{x}__")) for x in ("words", "lines", "sentences")})

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    made = {
        "chars": F.col("n__"), "words": F.col("words_all__"), "word_length": share("n__", "words_all__"), "upper": share("upper__", "n__"), "digits": share("digits__", "n__"), "symbols": share("symbols__", "n__"),
        "bars": share("bars__", "n__"), "shouts": share("shouts__", "n__"), "stops": share("stops__", "n__"), "spaces": share("spaces__", "n__"), "distinct_words": share("words_own__", "words_all__"), "lines": share("lines_all__", "words_all__"),
        "distinct_lines": share("lines_own__", "lines_all__"), "sentences": share("sentences_all__", "words_all__"), "distinct_sentences": share("sentences_own__", "sentences_all__"), "wide": share("bytes__", "n__"),
    }
    return step.select("kept__.*", F.struct(*[made[x].cast("double").alias(x) for x in STATISTICS]).alias("stat"))


class Rules(NamedTuple):
    intercept: float
    #: Each rule: its comparisons (statistic, whether it must exceed the threshold, threshold), and its weight.
    rules: list[tuple[tuple[tuple[str, bool, float], ...], float]]


def tree_paths(x: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray) -> tuple[list[tuple], np.ndarray]:
    """The paths of one tree for the second-order loss, and its value for each row."""
    codes = [np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)]
    value, paths = np.zeros(len(x)), []

    def grow(rows: np.ndarray, path: tuple) -> None:
        g, h = gradient[rows], hessian[rows]
        if path:
            paths.append(path)
        best = (1e-6, None)
        if len(path) < DEPTH and len(rows) >= 2 * LEAST_ROWS:
            for j, c in enumerate(cuts):
                if len(c):
                    k = codes[j][rows]
                    gs, hs, ns = (np.cumsum(np.bincount(k, w, len(c) + 1))[:-1] for w in (g, h, np.ones(len(k))))
                    gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - g.sum() ** 2 / (h.sum() + 1)
                    gain[(ns < LEAST_ROWS) | (ns > len(rows) - LEAST_ROWS)] = -1
                    if gain.max() > best[0] + 1e-9:
                        best = (gain.max(), (j, int(gain.argmax())))
        if best[1] is None:
            value[rows] = -g.sum() / (h.sum() + 1)
            return
        j, i = best[1]
        over = codes[j][rows] > i
        for side in (False, True):
            grow(rows[over == side], (*path, (j, side, float(cuts[j][i]))))

    grow(np.arange(len(x)), ())
    return paths, value


def covers(x: np.ndarray, rule: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, over, cut in rule:
        out &= (x[:, j] > cut) == over
    return out


def lasso(m: np.ndarray, y: np.ndarray, penalty: float, start: tuple[float, np.ndarray], steps: int = 250) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for logistic loss (mean) with an L1 penalty on all but the intercept."""
    b, w = start
    n = len(y)
    size = 4 / (np.linalg.norm(m, 2) ** 2 / n + 1)
    u, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-np.clip(m @ u + c, -500, 500))) - y
        nw = u - size * (m.T @ e) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - size * penalty, 0)
        nb = c - size * e.mean()
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        u, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        b, w, t = nb, nw, nt
    return b, w


def fit_rules(x: np.ndarray, y: np.ndarray) -> Rules:
    """Grow, extract, penalise; the penalty is the one that does best on every fifth row."""
    n = len(y)
    good = float(y.sum())
    prior = (good + 1) / (n + 2)
    prior = float(np.log(prior / (1 - prior)))
    if not 0 < good < n:
        return Rules(prior, [])
    cuts = []
    for j in range(x.shape[1]):
        at = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
        cuts.append(at[at < x[:, j].max()])
    z, rules = np.full(n, prior), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        paths, value = tree_paths(x, cuts, p - y, p * (1 - p))
        rules |= dict.fromkeys(tuple(sorted(set(r))) for r in paths)
        z += SHRINK * value
    kept, columns, seen = [], [], set()
    for rule in rules:
        c = covers(x, rule)
        if 0 < c.sum() < n and (mark := np.packbits(c).tobytes()) not in seen:
            seen.add(mark)
            kept.append(rule)
            columns.append(c)
    if not kept:
        return Rules(prior, [])
    m = np.array(columns, np.float64).T
    most = np.abs(m.T @ (y - y.mean())).max() / n
    test = np.arange(n) % 5 == 0
    start, best = (prior, np.zeros(len(kept))), (np.inf, PENALTIES[0])
    for share in PENALTIES:
        start = lasso(m[~test], y[~test], share * most, start, 120)
        q = m[test] @ start[1] + start[0]
        best = min(best, ((np.logaddexp(0, q) - y[test] * q).mean(), share))
    b, w = lasso(m, y, best[1] * most, (prior, np.zeros(len(kept))), 400)
    named = [(tuple((STATISTICS[j], over, cut) for j, over, cut in rule), float(v)) for rule, v in zip(kept, w, strict=True) if abs(v) > 1e-6]
    return Rules(float(b), named)


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = SAMPLE, text: str = "text") -> Rules:
    """Learn from labels (doc_id, quality) that are not held out; `held_out` is a column over doc_id."""
    chosen = sampled_labels(labels, "quality", held_out, sample)
    rows = statistics(docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")).select("doc_id", "label", "stat.*").toPandas()
    rows = rows.sort_values(["doc_id", *STATISTICS]).reset_index(drop=True)
    return fit_rules(rows[list(STATISTICS)].to_numpy(float), rows.label.to_numpy(float))


def compiled(model: Rules, stat: str = "stat") -> Column:
    """The probability of good quality as one expression over the statistics."""
    z = F.lit(model.intercept)
    for rule, weight in model.rules:
        met = F.lit(True)
        for name, over, cut in rule:
            value = F.col(f"{stat}.{name}")
            met = met & ((value > F.lit(cut)) if over else (value <= F.lit(cut)))
        z = z + F.when(met, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def score(docs: DataFrame, model: Rules, text: str = "text") -> DataFrame:
    """`docs` with stat and quality, the probability of good quality; columns of these names give way."""
    return statistics(without(docs, "quality"), text).withColumn("quality", compiled(model))
