"""b-bit MinHash near-duplicates with links confirmed on full shingle sets.

1. signatures(): words, word shingles, a 128-bit fingerprint of each shingle set, K minima of permuted shingle
   hashes; the minima's low bits are packed into 64-bit words, and every band of minima gives one bucket number.
   Rows with equal sets are one node from here on, so exact copies cost nothing further.
2. Each bucket is compared with one centre, the member that meets most others over all buckets, so a group of
   near copies gives a star, not all its pairs. A pair is first estimated from the packed bits (equal fields,
   corrected for chance collisions) and dropped only far below the threshold; the rest is confirmed exactly.
3. Confirmed links give components. Buckets that lie inside one component are finished. In the others, a node
   with too few shingles in common with all remaining nodes together can have no link and goes (exact bound);
   every remaining pair between different components is estimated and confirmed, so no link is lost that any
   bucket brought together. Pairs inside a component are never made.

Bands of all nodes are shuffled once, as pairs of numbers; signatures go only with nodes, shingle sets only with
nodes that share a bucket, and both to as few joins as may be.

Two sets at the threshold itself share no bucket with a probability of at most MISS.

Null and empty texts, and texts without words, have an empty set, link with nothing and are kept. Fewer words
than a shingle's length make one shingle of the whole sequence. Null ids join a group through their text; a
group's component is its smallest id that isn't null. Rows that repeat an id are separate rows. An empty table gives
an empty one. Of `docs` only the two named columns are read, so further columns of any name do no harm. Ids may be
of any type with an order, structs included."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm._shared import BROADCAST_BYTES, HOT, dealt_join, hot_keys, in_arrow, mix64, slices_of, small, text_bytes, written
from tidewheel.operators.components import components

#: Minima in a band, low bits kept of each, most probable loss of a pair at the threshold.
ROWS, BITS, MISS = 5, 2, 1e-7
#: Standard deviations below the threshold at which an estimate rules a pair out.
SURE = 5.2
#: Times that nodes without possible links are taken out.
PEELS = 2
#: One node in so many tells which buckets are hot; no result depends on it.
SCOUTS = 16
#: Word hashes that a worker remembers.
REMEMBERED = 300_000


def bands_for(percent: int) -> int:
    """As few bands as lose a pair of that similarity with a probability of at most MISS."""
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def least_equal_fields(percent: int, k: int) -> int:
    """Equal fields of k below which a pair is under the threshold for sure."""
    chance = 2.0**-BITS
    p = percent / 100 + (1 - percent / 100) * chance
    return math.floor(k * p - SURE * math.sqrt(k * p * (1 - p)))


class WordHashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def shingle_set(text: bytes, words: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles. bytes.lower() and bytes.split() handle just A-Z and the six ASCII white-space bytes."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    if len(h) < words:
        h = np.append(h, np.full(words - len(h), len(h), np.uint64))
    n = len(h) - words + 1
    out = np.zeros(n, np.uint64)
    for i in range(words):
        out = mix64(out + h[i : i + n] + np.uint64(i))
    return np.unique(out)


def permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of k permutations, the same in every process."""
    x = mix64(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:k] | np.uint64(1), x[k:]


def minima(shingles: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The least permuted hash for each permutation; long sets go through in pieces."""
    least = np.full(len(factors), np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), 4096):
        x = shingles[None, i : i + 4096] * factors[:, None] + offsets[:, None]
        x ^= x >> np.uint64(32)
        least = np.minimum(least, (x * np.uint64(0xD6E8FEB86659FD93)).min(1))
    return least


def pack(least: np.ndarray) -> list[int]:
    """The low BITS of each minimum, 64 // BITS to a signed 64-bit word."""
    fields = least & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    fields = np.append(fields, np.zeros(-len(fields) % per, np.uint64)).reshape(-1, per)
    return (fields << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(1, dtype=np.uint64).view(np.int64).tolist()


def band_keys(least: np.ndarray, bands: int) -> list[int]:
    grid = least[: bands * ROWS].reshape(bands, ROWS)
    key = np.arange(bands, dtype=np.uint64)
    for i in range(ROWS):
        key = mix64(key + grid[:, i])
    return key.view(np.int64).tolist()


def signatures(docs: DataFrame, percent: int, words: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, node (the set's fingerprint; null for an empty set), bits, buckets."""
    bands = bands_for(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (factors, offsets) = WordHashes(), permutations(bands * ROWS)
        for batch in batches:
            for part in slices_of(batch, 1):
                sizes, nodes, bits, buckets = [], [], [], []
                for x in text_bytes(part.column(1)):
                    s = shingle_set(x, words, hashes)
                    sizes.append(len(s))
                    if not len(s):
                        for to in (nodes, bits, buckets):
                            to.append(None)
                        continue
                    least = minima(s, factors, offsets)
                    nodes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    bits.append(pack(least))
                    buckets.append(band_keys(least, bands))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(bits, pa.list_(pa.int64())), pa.array(buckets, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "node", "bits", "buckets"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).transform(in_arrow, run, f"doc_id {kind}, n_shingles bigint, node binary, bits array<bigint>, buckets array<bigint>")


def sets_of(docs: DataFrame, words: int, wanted: DataFrame, text: str, key: str) -> DataFrame:
    """node and its sorted shingle hashes, one row each, for at least the rows whose id is in `wanted` (doc_id), a written table, or null.

    Texts are never shuffled: wanted ids are broadcast as hashes, in as many passes over the texts as their bytes take."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in slices_of(batch, 0):
                found = [shingle_set(x, words, hashes) for x in text_bytes(part.column(0))]
                nodes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], names=["node", "shingles"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).withColumn("hash", F.xxhash64("doc_id"))
    hashed = wanted.select(F.xxhash64("doc_id").alias("hash")).distinct()
    passes = max(1, math.ceil(16 * wanted.count() / BROADCAST_BYTES))
    found = None
    for i in range(passes):
        turn = F.pmod(F.col("hash"), F.lit(passes)) == i
        some = rows.where(turn).join(F.broadcast(hashed.where(turn)), "hash", "left_semi").where("doc_id is not null")
        if not i:
            some = some.unionByName(rows.where("doc_id is null"))
        some = written(some.select("text").transform(in_arrow, run, "node binary, shingles array<bigint>"))
        found = some if found is None else found.unionByName(some)
    if found.count() > found.select("node").distinct().count():  # ids or texts repeat
        found = written(found.groupBy("node").agg(F.first("shingles").alias("shingles")))
    return found


def equal_fields(a: str, b: str, k: int):
    """Fields with equal bits of two packed signatures; those that fill the last word count as k's part."""
    words = -(-k * BITS // 64)
    apart = []
    for i in range(words):
        x = f"({a}[{i}] ^ {b}[{i}])"
        apart.append(f"bit_count(({x} | shiftrightunsigned({x}, 1)) & 6148914691236517205L)")
    return F.expr(f"{k} - ({' + '.join(apart)})")


def alike(percent: int, k: int):
    """The condition that a pair (n_a, bits_a), (n_b, bits_b) may reach the threshold."""
    sizes = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    return sizes & (equal_fields("bits_a", "bits_b", k) >= least_equal_fields(percent, k))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    both = pairs.select("a", "b").distinct().join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("t")), "b")
    both = both.select("a", "b", F.size("s").alias("n"), F.size("t").alias("m"), F.size(F.array_intersect("s", "t")).alias("i"))
    return both.where(F.expr(f"100 * i >= {percent} * (n + m - i)")).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_shingles, component_id (the smallest id reachable over links of
    at least `percent` per cent), kept (whether that is its own id)."""
    k = bands_for(percent) * ROWS
    rows = written(signatures(docs, percent, words, text, key))
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits"), F.first("buckets").alias("buckets"))
    nodes = written(nodes.withColumn("number", F.monotonically_increasing_id()))
    met, hot = shared_buckets(nodes.select("number", F.explode("buckets").alias("bucket")))
    met = written(met)
    # a node's weight is the number of those that it meets; ties fall to a scramble of the node
    weight = met.groupBy("number").agg(F.sum("met").alias("weight"))
    meeting = nodes.select("number", "node", "least", "n", "bits").join(weight, "number")
    members = written(met.join(meeting, "number").drop("number"))
    wanted = written(members.select(F.col("least").alias("doc_id")).where("doc_id is not null").distinct())
    sets = sets_of(docs, words, wanted, text, key)

    centre = members.groupBy("bucket").agg(F.max(F.struct("weight", F.xxhash64("node").alias("place"), "node", "n", "bits")).alias("c"))
    centre = centre.select("bucket", F.col("c.node").alias("a"), F.col("c.n").alias("n_a"), F.col("c.bits").alias("bits_a"))
    stars = dealt_join(members.select("bucket", "node", "n", "bits"), centre, "bucket", hot, "node").where("node != a").withColumnsRenamed({"node": "b", "n": "n_b", "bits": "bits_b"})
    links = written(confirmed(stars.where(alike(percent, k)), sets, percent))
    groups = components(links)

    open_ = unfinished(members, groups, hot)
    for _ in range(PEELS):
        open_ = without_hopeless(open_, sets, percent, hot)
    # of a node's buckets only those still open are needed to tell which is the first that a pair has in common
    open_ = written(open_.join(open_.groupBy("node").agg(F.collect_list("bucket").alias("buckets")), "node"))
    side = ["part", "node", "n", "bits", "u", "buckets"]
    left = open_.select("bucket", *[F.col(x).alias(f"{x}_a") for x in side])
    right = open_.select(F.col("bucket").alias("bucket_b"), *[F.col(x).alias(f"{x}_b") for x in side])
    reach = F.expr(f"100 * least(u_a, u_b) >= {percent} * (n_a + n_b - least(u_a, u_b))")
    once = F.expr("bucket = array_min(array_intersect(buckets_a, buckets_b))")  # a pair meets in its first common bucket only
    across = left.join(right, (F.col("bucket") == F.col("bucket_b")) & (F.col("part_a") < F.col("part_b")) & reach & alike(percent, k) & once)
    across = across.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    links = links.unionByName(confirmed(across, sets, percent))
    groups = components(written(links))

    least = nodes.join(groups, "node").groupBy("root").agg(F.min("least").alias("smallest"))
    linked = groups.join(least, "root").select("node", "smallest")
    alone = nodes.select("node", F.col("least").alias("own"))
    of_node = alone.join(linked, "node", "left").select("node", F.coalesce("smallest", "own").alias("found"))
    # equal sets may be a third of all rows; the empty set has no node
    rows = rows.select("doc_id", "n_shingles", "node", F.monotonically_increasing_id().alias("row"))
    rows = rows.select("doc_id", "n_shingles", "row", F.col("node").isNull().alias("empty"), F.coalesce("node", F.col("row").cast("string").cast("binary")).alias("node"))
    out = dealt_join(rows, of_node, "node", hot_keys(nodes.select("node", F.col("copies").alias("n")), "node"), "row", "left")
    component = F.when(F.col("empty"), F.col("doc_id")).otherwise(F.col("found"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def shared_buckets(spread: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows (number, bucket) whose bucket has several, with met, about how many, and the hot buckets as hot_keys gives them.

    One shuffle brings a bucket together and counts it. Buckets so large that this would burden a task are found by a part of all numbers; they stay where they are."""
    scouts = spread.where(F.pmod(F.xxhash64("number"), F.lit(SCOUTS)) == 0).groupBy("bucket").agg((F.count("*") * SCOUTS).alias("n"))
    hot = hot_keys(written(scouts.where(F.col("n") > HOT)), "bucket")
    cold = spread if hot is None else spread.join(hot, "bucket", "left_anti")
    met = cold.select("bucket", "number", F.count("*").over(Window.partitionBy("bucket")).alias("met")).where("met > 1")
    if hot is not None:
        met = met.unionByName(spread.join(hot, "bucket").select("bucket", "number", (F.col("parts__") * F.lit(HOT).cast("bigint")).alias("met")))
    return met, hot


def unfinished(members: DataFrame, groups: DataFrame, hot: DataFrame | None) -> DataFrame:
    """The members, with the part (component) of each, of buckets that hold more than one part."""
    parts = members.join(groups, "node", "left").withColumn("part", F.coalesce("root", "node")).select("bucket", "node", "part", "n", "bits")
    several = parts.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low != high").select("bucket")
    return written(dealt_join(parts, several, "bucket", hot, "node"))


def without_hopeless(open_: DataFrame, sets: DataFrame, percent: int, hot: DataFrame | None) -> DataFrame:
    """Drop nodes that can have no link, and give the others u, the number of their shingles in other remaining sets.

    An intersection is at most u, so with another set of m shingles, m >= u, the similarity is at most
    u / (n + m - u), and at most u / n with any smaller one; m is at least the least size in the node's buckets."""
    if "u" in open_.columns:
        open_ = open_.drop("u")
    smallest = open_.groupBy("bucket").agg(F.min("n").alias("m"))
    nodes = dealt_join(open_.select("bucket", "node", "n"), smallest, "bucket", hot, "node").groupBy("node").agg(F.first("n").alias("n"), F.min("m").alias("m"))
    nodes = written(nodes)
    left = sets.join(small(nodes.select("node")), "node", "left_semi")
    each = left.select("node", F.explode("shingles").alias("shingle"))
    common = each.groupBy("shingle").agg(F.count("*").alias("sets")).where("sets > 1").select("shingle")
    useful = each.join(common, "shingle").groupBy("node").agg(F.count("*").alias("u"))
    hopeful = useful.join(nodes, "node").where(F.expr(f"100 * u >= {percent} * (n + greatest(0, m - u))")).select("node", "u")
    return written(open_.join(hopeful, "node"))
