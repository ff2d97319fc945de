"""Toxicity by character n-grams: a linear classifier whose features are scaled by naive Bayes log-count ratios.

A text is lower-cased and its white space made single spaces; its n-grams of ORDERS characters are hashed into
BUCKETS. Over a bounded sample of labelled rows, Spark counts for each bucket the toxic and the clean texts that
have it, and keeps the FEATURES buckets with the strongest evidence (chi-squared). A feature's value is its
log-count ratio where the text has it, else 0; L2-regularised logistic regression on these values is fitted on
the driver, whose input is bounded by SAMPLE rows and FEATURES columns. Scoring hashes every n-gram of every
whole text and adds the weights of the distinct features found.

Null and empty texts have no n-grams and get the score of the intercept. Without labelled rows of both kinds the
score is the smoothed share of toxic ones, (toxic + 1) / (rows + 2). Rows are scored one by one, so repeated ids
and texts do no harm; conflicting labels of an id count as toxic; null ids have no label. An empty table gives an
empty one."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm._shared import beside, column_list, in_arrow, mix64, sampled_labels, slices_of, text_bytes, written

#: Characters of an n-gram, hashed buckets, features kept, labelled rows used at most.
ORDERS, BUCKETS, FEATURES, SAMPLE = (4, 5, 6), 1 << 20, 6000, 16_000
#: Bytes of text whose n-grams are held at once; a longer text is held alone.
SLICE = 250_000
#: Added to counts; texts that a feature must occur in; strength of the L2 penalty.
SMOOTHING, LEAST_TEXTS, PENALTY = 1.0, 4, 0.1


class Model(NamedTuple):
    intercept: float
    buckets: np.ndarray
    weights: np.ndarray


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every n-gram of every text, repeats included."""
    folded = [f" {re.sub(r'\s+', ' ', x.decode(errors='replace').lower()).strip()} " for x in texts]
    code = np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(x) for x in folded], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    stop = np.cumsum(sizes)
    own, found = [], []
    rolled = code.copy()
    for n in range(2, max(ORDERS) + 1):
        rolled = rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :]
        if n in ORDERS:
            inside = np.arange(len(rolled)) + n <= stop[owner[: len(rolled)]]
            own.append(owner[: len(rolled)][inside])
            found.append((mix64(rolled[inside] + np.uint64(n)) >> np.uint64(44)).astype(np.int64))
    return np.concatenate(own), np.concatenate(found)


def distinct(own: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(own * BUCKETS + found)
    return both // BUCKETS, both % BUCKETS


def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, toxic and clean texts that have it, for the (label, text) rows of a task."""
    total = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for part in slices_of(batch, 1, SLICE):
            own, found = distinct(*grams(text_bytes(part.column(1))))
            label = np.array(part.column(0).to_pylist())[own]
            for k in (0, 1):
                total[k] += np.bincount(found[label == k], minlength=BUCKETS)
    at = np.flatnonzero(total.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[1][at], pa.int64()), pa.array(total[0][at], pa.int64())], names=["bucket", "toxic", "clean"])


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = SAMPLE, text: str = "text") -> Model:
    """Learn from labels (doc_id, toxic) that are not held out; `held_out` is a column over doc_id."""
    chosen = sampled_labels(labels, "toxic", held_out, sample)
    rows = written(docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text"))
    n = {int(r.label): r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        share = (toxic + 1) / (toxic + clean + 2)
        return Model(float(np.log(share / (1 - share))), np.empty(0, np.int64), np.empty(0))
    seen = rows.select("label", "text").transform(in_arrow, counts, "bucket bigint, toxic bigint, clean bigint").groupBy("bucket").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where(F.col("t") + F.col("c") >= LEAST_TEXTS)
    off = F.col("t") * F.lit(float(clean)) - F.col("c") * F.lit(float(toxic))
    chi = off * off / ((F.col("t") + F.col("c")) * F.lit(float(toxic * clean)) * (F.lit(float(toxic + clean)) - F.col("t") - F.col("c") + 1e-9))
    best = seen.withColumn("chi", chi).orderBy(F.desc("chi"), "bucket").limit(FEATURES).toPandas().sort_values("bucket")
    buckets = best.bucket.to_numpy(np.int64)
    p, q = best.t.to_numpy(float) + SMOOTHING, best.c.to_numpy(float) + SMOOTHING
    ratio = np.log(p / (toxic + 2 * SMOOTHING)) - np.log(q / (clean + 2 * SMOOTHING))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(BUCKETS, -1, np.int32)
        place[buckets] = np.arange(len(buckets))
        for batch in batches:
            for part in slices_of(batch, 2, SLICE):
                own, found = grams(text_bytes(part.column(2)))
                found = place[found]
                own, found = distinct(own[found >= 0], found[found >= 0].astype(np.int64))
                edges = np.searchsorted(own, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([found[a:b].astype("<u4").tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary())], names=["doc_id", "label", "features"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    table = rows.transform(in_arrow, present, f"doc_id {kind}, label int, features binary").toPandas()
    table = table.sort_values(["doc_id", "features"])
    lists = [np.frombuffer(x, "<u4") for x in table.features]
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    intercept, w = logistic(row, np.concatenate(lists).astype(np.int64), ratio, table.label.to_numpy(float), len(buckets))
    return Model(intercept, buckets, w * ratio)


def logistic(row: np.ndarray, column: np.ndarray, scale: np.ndarray, y: np.ndarray, width: int, steps: int = 60) -> tuple[float, np.ndarray]:
    """Intercept and weights of L2-regularised logistic regression on sparse values scale[column], by L-BFGS."""
    value = scale[column]

    def loss(w):
        z = np.bincount(row, value * w[1:][column], len(y)) + w[0]
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        e = p - y
        g = np.concatenate([[e.sum()], np.bincount(column, value * e[row], width) + PENALTY * w[1:]])
        return np.logaddexp(0, z).sum() - y @ z + PENALTY / 2 * (w[1:] @ w[1:]), g

    w = np.zeros(width + 1)
    f, g = loss(w)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, keep = g.copy(), []
        for s, t in reversed(pairs):
            a = (s @ d) / (s @ t)
            d -= a * t
            keep.append(a)
        d *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, np.linalg.norm(g))
        for (s, t), a in zip(pairs, reversed(keep), strict=True):
            d += s * (a - (t @ d) / (s @ t))
        size, slope = 1.0, -(g @ d)
        while (new := loss(w - size * d))[0] > f + 1e-4 * size * slope and size > 1e-10:
            size /= 2
        s, t = -size * d, new[1] - g
        w, done = w + s, f - new[0] < 1e-7 * abs(f)
        f, g = new
        if s @ t > 1e-12:
            pairs = [*pairs[-7:], (s, t)]
        if done:
            break
    return float(w[0]), w[1:]


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep` and toxicity, the probability that a text is toxic; a kept column of that name gives way to it."""
    intercept, buckets, weights = model
    keep = tuple(c for c in keep if c.lower() != "toxicity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(BUCKETS)
        weight[buckets] = weights
        counted = weight != 0
        for batch in batches:
            for part in slices_of(batch, len(keep), SLICE):
                own, found = grams(text_bytes(part.column(len(keep))))
                hit = counted[found]
                own, found = distinct(own[hit], found[hit])
                z = intercept + np.bincount(own, weight[found], part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())], names=[*keep, "toxicity"])

    return docs.select(*keep, beside(keep, text)).transform(in_arrow, run, f"{column_list(docs, keep)}, toxicity double")
