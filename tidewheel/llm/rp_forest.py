"""Nearest neighbours by largest inner product with a forest of random-projection trees.

Inner products become angles by one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm; queries get 0.
On a bounded sample of distinct vectors each tree splits by the difference of two random points at the median.
All rows are put into one leaf a tree. A query walks all trees with one shared priority queue (a node's priority
is the least margin on its way) and visits so many leaves; whatever lies in these is ranked by exact inner products
in double precision. How many leaves is measured, not set: for a bounded sample of queries the true neighbours are
found among all rows, and their leaves' places in the queue give the number that finds the share RECALL of them. So
clustered vectors need few leaves and random ones many, at every size by the same rule.

Large leaves are cut into cells, a tree's cells are dealt to groups of bounded size, a query goes only to groups that
it visits, and a group that too many queries visit is repeated for parts of them. Of each group only every query's best
leave it.

Equal vectors are one entry with their smallest ids (as many as a result can hold, and one), so a third of all
rows may be the same vector. Vectors that are null, zero, of a length other than the most frequent one, or hold
null or non-finite components take no part; null ids take no part; a row that repeats an id and its vector counts
once. Fewer candidates than asked for: all of them that were found. Ties go to the smaller id. An empty table, or one
without queries, gives an empty result. Only the two named columns are read, so others may have any name."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewheel.llm._shared import in_arrow, written

#: Distinct vectors that the trees are fitted on at most; trees; rows a leaf should hold; least sample rows of a leaf.
SAMPLE, TREES, LEAF, LEAST_LEAF = 40_000, 32, 32, 8
#: Share of the true neighbours that the leaves visited should hold, and queries that it is measured with.
RECALL, MEASURED = 0.93, 64
#: Rows of a cell, rows and queries of a group, products held at once.
CELL, GROUP, TOGETHER = 32_768, 65_536, 2_000_000
SEED = 20


class Forest(NamedTuple):
    """Node arrays over all trees: a node's normal is points[pairs[0]] - points[pairs[1]]; below are its children, or (-1, leaf)."""

    points: np.ndarray
    pairs: np.ndarray
    cuts: np.ndarray
    below: np.ndarray
    roots: np.ndarray
    largest: float

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.largest**2 - (x * x).sum(1)))
        return np.column_stack([x, more])

    @property
    def leaves(self) -> int:
        return int((self.below[:, 0] < 0).sum())

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        y, out = self.lifted(x, False), np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            todo = [(root, np.arange(len(x)))]
            while todo:
                node, rows = todo.pop()
                if self.below[node, 0] < 0:
                    out[rows, t] = self.below[node, 1]
                elif len(rows):
                    a, b = self.pairs[node]
                    right = y[rows] @ (self.points[a] - self.points[b]) > self.cuts[node]
                    todo += [(self.below[node, k], rows[right == bool(k)]) for k in (0, 1)]
        return out

    def probes_of(self, x: np.ndarray, probes: int) -> list[list[int]]:
        """The leaves that each query visits, best first, over all trees; only nodes that are reached are looked at."""
        found, below, cuts = [], self.below.tolist(), self.cuts.tolist()
        pairs, points, roots = self.pairs.tolist(), self.points, self.roots.tolist()
        for y in self.lifted(x, True):
            heap, own = [(-np.inf, root) for root in roots], []
            while heap and len(own) < probes:
                worst, node = heapq.heappop(heap)
                left, right = below[node]
                if left < 0:
                    own.append(right)
                    continue
                a, b = pairs[node]
                margin = float(y @ (points[a] - points[b])) - cuts[node]
                heapq.heappush(heap, (max(worst, -margin), right))
                heapq.heappush(heap, (max(worst, margin), left))
            found.append(own)
        return found

    def places_of(self, query: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """The place in a query's queue, from 1, at which it comes to the first of a row's leaves, for each row."""
        y = self.lifted(query[None], True)[0]
        along = self.points @ y
        margin = along[self.pairs[:, 0]] - along[self.pairs[:, 1]] - self.cuts
        worst = np.full(len(self.cuts), -np.inf)
        level = self.roots
        while len(level):
            level = level[self.below[level, 0] >= 0]
            for k, sign in ((0, 1.0), (1, -1.0)):
                worst[self.below[level, k]] = np.maximum(worst[level], sign * margin[level])
            level = self.below[level].ravel()
        at = np.flatnonzero(self.below[:, 0] < 0)
        of_leaf = np.empty(len(at))
        of_leaf[self.below[at, 1]] = worst[at]
        return np.searchsorted(np.sort(of_leaf), of_leaf[leaves].min(1), "right")


def grow(sample: np.ndarray, leaves: int, trees: int, largest: float, seed: int = SEED) -> Forest:
    """Trees of about `leaves` leaves each; leaf numbers are unique over the forest."""
    rng = np.random.default_rng(seed)
    more = np.sqrt(np.maximum(0, largest**2 - (sample * sample).sum(1)))
    y = np.column_stack([sample, more])
    pairs, cuts, below, roots, leaf = [], [], [], [], 0
    least = max(LEAST_LEAF, -(-len(sample) // max(1, leaves)))
    for _ in range(trees):
        roots.append(len(cuts))
        todo = [(np.arange(len(y)), None)]
        while todo:
            rows, parent = todo.pop()
            node = len(cuts)
            if parent is not None:
                below[parent[0]][parent[1]] = node
            pair, cut, right = (0, 0), 0.0, None
            if len(rows) >= 2 * least:
                for _ in range(5):
                    pair = tuple(rows[rng.integers(0, len(rows), 2)].tolist())
                    along = y[rows] @ (y[pair[0]] - y[pair[1]])
                    cut = float(np.median(along))
                    right = along > cut
                    if 0 < right.sum() < len(rows):
                        break
                    right = None
            pairs.append(pair)
            cuts.append(cut)
            if right is None:
                below.append([-1, leaf])
                leaf += 1
            else:
                below.append([-2, -2])
                todo += [(rows[~right], (node, 0)), (rows[right], (node, 1))]
    return Forest(y, np.array(pairs), np.array(cuts), np.array(below), np.array(roots), largest)


def best_of(query: np.ndarray, first: np.ndarray, entry: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """The `most` best entries of each query, each once, ties by smallest id and then by entry."""
    order = np.lexsort((entry, first, -score, query))
    query, first, entry, score = (x[order] for x in (query, first, entry, score))
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (entry[1:] != entry[:-1]) | (score[1:] != score[:-1])
    query, first, entry, score = (x[new] for x in (query, first, entry, score))
    start = np.searchsorted(query, query)
    kept = np.arange(len(query)) - start < most
    return query[kept], first[kept], entry[kept], score[kept]


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part, each pair once."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"))
    fine = F.expr("size(embedding) > 0 and exists(embedding, x -> x != 0) and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select("vec_id", F.transform("embedding", lambda x: x + F.lit(0.0)).alias("embedding"))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products in double precision; each depends on its two vectors only."""
    return np.einsum("ij,kj->ik", q, x)


def measured(stored: DataFrame, queries: DataFrame, forest: Forest, k: int, width: int, recall: float) -> int:
    """Leaves to visit, by the queue places of the true neighbours of up to MEASURED queries among all rows."""
    some = queries.orderBy(F.xxhash64("entry", F.lit(SEED)), "entry").limit(MEASURED).toPandas()
    q, own = np.array(some.embedding.tolist(), float).reshape(-1, width), some.entry.to_numpy()
    spark = stored.sparkSession
    sent = spark.sparkContext.broadcast((q, own))  # MEASURED vectors

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, own = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            entry = batch.column(0).to_numpy()
            score = products(q, matrix(batch.column(1), width))
            score[own[:, None] == entry[None]] = -np.inf
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            kept = np.isfinite(np.take_along_axis(score, top, 1))
            at = top[kept]
            number = np.repeat(np.arange(len(q)), kept.sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(score[number, at], pa.float64()), batch.column(0).take(pa.array(at)), batch.column(2).take(pa.array(at))], names=["query", "score", "entry", "leaves"])

    found = stored.select("entry", "embedding", "leaves").transform(in_arrow, search, "query int, score double, entry bigint, leaves array<int>")
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "entry"))).where(F.col("place") <= k).select("query", "leaves").toPandas()
    sent.unpersist()
    places = [forest.places_of(q[n], np.array(of.leaves.tolist())) for n, of in found.groupby("query")]
    return int(np.quantile(np.concatenate(places), recall, method="higher")) if places else forest.leaves


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(np.float64)


def nearest(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL, trees: int = TREES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the `k` largest inner products found for each row where `is_query`
    (a column over vec_id) holds."""
    narrow = vectors.schema[vector].dataType.simpleString() == "array<float>"
    kind = "float" if narrow else "double"  # single-precision vectors travel as they are
    rows = usable(vectors, key, vector)
    sizes = rows.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()
    width = sizes[0].n if sizes else 1
    rows = written(rows.where(F.size("embedding") == width))
    at = Window.partitionBy("embedding").orderBy("vec_id")
    first = rows.distinct().withColumn("place", F.row_number().over(at)).where(F.col("place") <= k + 1)
    first = first.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = rows.where(is_query).select("vec_id", "embedding").distinct()
    wanted = asked.select("embedding").distinct().withColumn("asked", F.lit(True))
    # one entry is one (first id, vector): equal ids with different vectors stay apart
    entries = written(first.join(wanted, "embedding", "left").select(F.xxhash64("embedding", F.get("ids", F.lit(0))).alias("entry"), "embedding", "ids", F.coalesce("asked", F.lit(False)).alias("asked")))
    counted = entries.agg(F.count("*").alias("n"), F.count(F.when(F.col("asked"), 1)).alias("asked"), F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))).alias("largest")).first()
    n = counted.n
    if not counted.asked:
        return entries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = min(1.0, SAMPLE / n)
    chosen = entries.where(F.pmod(F.xxhash64("entry", F.lit(SEED)), F.lit(1_000_000)) < int(share * 1_000_000)).orderBy("entry").select("embedding").toPandas().embedding
    forest = grow(np.array(chosen.tolist(), float).reshape(-1, width), max(1, n // LEAF), trees, float(counted.largest))
    sent = entries.sparkSession.sparkContext.broadcast(forest)  # bounded by SAMPLE vectors and SAMPLE / LEAST_LEAF leaves a tree

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.leaves_of(matrix(batch.column(1), width)).tolist(), pa.list_(pa.int32()))], names=["entry", "embedding", "first", "leaves"])

    plain = entries.select("entry", F.col("embedding").cast(f"array<{kind}>").alias("embedding"), F.get("ids", F.lit(0)).alias("first"), "asked")
    stored = written(plain.drop("asked").transform(in_arrow, place, f"entry bigint, embedding array<{kind}>, first bigint, leaves array<int>"))
    queries = plain.where("asked").select("entry", "embedding")
    probes = measured(stored, queries, forest, k, width, recall)
    # as many counters as there are leaves, which the sample bounds
    held = stored.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).toPandas()
    rows_in, cells = np.zeros(forest.leaves, np.int64), np.ones(forest.leaves, np.int64)
    rows_in[held.leaf] = held.n
    cells = np.maximum(1, -(-rows_in // CELL))
    base = np.cumsum(cells) - cells
    # a tree's cells, in order, fill groups of GROUP rows; no group spans two trees, so that a query meets a group a tree as long as those suffice
    of_leaf = np.repeat(np.arange(forest.leaves), cells)
    filled = np.cumsum((rows_in / cells)[of_leaf]) - (rows_in / cells)[of_leaf]
    tree = np.floor(filled / n + 1e-9).astype(np.int64)
    parts = -(-n // GROUP)
    group_of = tree * parts + np.minimum(parts - 1, ((filled - tree * n) * parts / n + 1e-9).astype(np.int64))
    groups = int(group_of.max()) + 1
    table = pd.DataFrame({"leaf": np.arange(forest.leaves, dtype=np.int32), "of": [list(range(x, x + c)) for x, c in zip(base.tolist(), cells.tolist(), strict=True)], "groups": [group_of[x : x + c].tolist() for x, c in zip(base, cells, strict=True)]})
    table = entries.sparkSession.createDataFrame(table, "leaf int, of array<int>, groups array<bigint>")
    each = stored.select("entry", "first", "embedding", F.explode("leaves").alias("leaf")).join(F.broadcast(table), "leaf")
    own = F.pmod(F.xxhash64("entry"), F.size("of")).cast("int")
    each = each.select("entry", "first", "embedding", F.get("of", own).alias("cell"), F.get("groups", own).alias("group"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows, of, lists = [], [], []
                for k, leaves in enumerate(sent.value.probes_of(matrix(part.column(1), width), probes)):
                    own = np.sort(np.concatenate([np.arange(base[x], base[x] + cells[x]) for x in leaves]))
                    group = group_of[own]
                    edge = np.flatnonzero(np.diff(group, prepend=-1, append=groups))
                    for lo, hi in zip(edge, edge[1:], strict=False):
                        rows.append(k)
                        of.append(int(group[lo]))
                        lists.append(own[lo:hi].astype(np.int32))
                taken = part.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(lists, pa.list_(pa.int32())), pa.array(of, pa.int64())], names=["entry", "embedding", "cells", "group"])

    visits = written(queries.transform(in_arrow, walk, f"entry bigint, embedding array<{kind}>, cells array<int>, group bigint"))
    # as many rows as there are groups; few of them need more than one turn
    turns = visits.groupBy("group").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("turns"))
    visits = visits.join(F.broadcast(turns), "group").withColumn("turn", F.pmod(F.xxhash64("entry", F.lit(SEED)), F.col("turns")).cast("int")).drop("turns")
    each = each.join(F.broadcast(turns), "group").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("turns")
    most = k + 1

    def rank(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        kept: list[np.ndarray] = [np.empty(0, t) for t in ("int64", "int64", "int64", "float64")]
        if len(a) and len(b):
            a = a.sort_values("cell", kind="stable")
            x, q = np.stack(a.embedding).astype(float), np.stack(b.embedding).astype(float)
            ids, lows, cell = a.entry.to_numpy(), a["first"].to_numpy(), a.cell.to_numpy()
            asking = np.repeat(np.arange(len(b)), b.cells.map(len))
            asked_cell = np.concatenate(b.cells.to_list())
            order = np.argsort(asked_cell, kind="stable")
            asking, asked_cell = asking[order], asked_cell[order]
            new, waiting = [], 0
            starts = np.flatnonzero(np.diff(asked_cell, prepend=-1))
            for at, stop in zip(starts, [*starts[1:], len(asked_cell)], strict=True):
                lo, hi = np.searchsorted(cell, [asked_cell[at], asked_cell[at] + 1])
                step = max(1, TOGETHER // max(1, hi - lo))
                for i in range(at, stop if hi > lo else at, step):
                    w = asking[i : min(stop, i + step)]
                    m = hi - lo
                    new.append((np.repeat(w, m), np.tile(lows[lo:hi], len(w)), np.tile(ids[lo:hi], len(w)), products(q[w], x[lo:hi]).ravel()))
                    waiting += len(w) * m
                    if waiting > TOGETHER:
                        kept = best_of(*(np.concatenate([old, *more]) for old, more in zip(kept, zip(*new, strict=True), strict=True)), most)
                        new, waiting = [], 0
            if new:
                kept = best_of(*(np.concatenate([old, *more]) for old, more in zip(kept, zip(*new, strict=True), strict=True)), most)
            kept = [b.entry.to_numpy()[kept[0]], *kept[1:]]
        return pd.DataFrame(dict(zip(("query", "first", "entry", "score"), kept, strict=True)))

    keys = ["group", "turn"]
    pairs = each.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInPandas(rank, "query long, first long, entry long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "first", "entry")
    pairs = pairs.groupBy("query", "first", "entry").agg(F.max("score").alias("score")).withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)
    ids = pairs.join(entries.select("entry", "ids"), "entry").select("query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    short = ids.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("query", "score", "vec_id")
    found = short.join(entries.select(F.col("entry").alias("query"), "embedding"), "query")
    answers = written(found.groupBy("query", "embedding").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("list")))
    out = asked.withColumnRenamed("vec_id", "query_id").join(answers, "embedding")
    others = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return out.select("query_id", F.posexplode(others).alias("i", "x")).select("query_id", (F.col("i") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))
