"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets: SHARE of all words is shared by weight; a source's target stops at COPIES times its size and the excess
goes to the others by weight, until none is above (found in one pass: sources ordered by COPIES * size / weight
fill up one after another). Words are dealt in blocks of BLOCK: the blocks of the whole mix go to sources by the
highest quotients target / (2k + 1), a source's blocks to its shards by the same rule over the shards' sizes, so
every shard has a whole quota. A shard's documents lie end to end in a seeded order; the quota is taken as whole
passes over the shard and, for the rest, as a run of blocks that starts at a seeded block and goes round.

Only DataFrame functions; texts are read once, for their word counts, and only (id, source, size) is shuffled.
Hash shards split hot sources: at most MOST_SHARDS for a source, of SHARD words or more. Which seats can be
decided late is bounded from both sides beforehand (the divisor lies between two known values), so the ranking
sees about two quotients for a source or shard, not every block.

Null and empty texts have size 0 and get nothing. Null sources are one source, after all others. Null ids and
repeated rows count as rows of their own; without an id the text's digest gives the place in the seeded order. A table without words, or
without rows, mixes to nothing. Only the columns doc_id, source and text are read, so others may have any name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewheel.llm._shared import WORD, small, written

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words; most copies of a document; words in a block; least words and most number of a source's shards.
SHARE, COPIES, BLOCK, SHARD, MOST_SHARDS = 1.5, 2, 128, 65_536, 4096
SEED = "mix"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, name (the id, or without one a digest of the text), source, size: the number of words of the whole text."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))
    return docs.select("doc_id", name.alias("name"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, place (its rank, from 1), target."""
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("place") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    own = own.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", weight)
    full = Window.orderBy(F.col("room"), F.col("place"))
    own = own.withColumn("room", (COPIES * F.col("source_size")).cast("double") / F.col("weight"))
    own = own.withColumns({
        "filled": F.coalesce(F.sum(COPIES * F.col("source_size")).over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "waiting": F.sum("weight").over(full.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "all_words": F.sum("source_size").over(Window.partitionBy()),
    })
    own = own.withColumn("level", (SHARE * F.col("all_words") - F.col("filled")) / F.col("waiting"))
    own = own.withColumn("level", F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "place", "level"))).over(Window.partitionBy())["level"])
    own = own.withColumn("target", F.least((COPIES * F.col("source_size")).cast("double"), F.col("level") * F.col("weight")))
    return own.select("source", "source_size", "place", "target")


def seats(parties: DataFrame, within: list[str], key: list[str], votes: str, total: Column, out: str) -> DataFrame:
    """Sainte-Lague: `parties` with the whole number `out` of seats of each, `total` seats to share `within` each group.

    With n parties the final divisor lies between sum / (total + n / 2) and sum / (total - n / 2), hence each
    party's seats between two bounds; the seats between them are ranked by quotient, ties by `key`."""
    group = Window.partitionBy(*within)
    p = parties.withColumns({"seats__": total.cast("long"), "n__": F.count(F.lit(1)).over(group), "sum__": F.sum(votes).over(group)})
    share = F.coalesce(F.try_divide(F.col(votes).cast("double"), F.col("sum__").cast("double")), F.lit(0.0))
    p = p.withColumn("low__", F.greatest(F.lit(0), F.floor(share * (F.col("seats__") - F.col("n__") / 2) + 0.5) - 1))
    p = p.withColumn("high__", F.when(F.col(votes) > 0, F.floor(share * (F.col("seats__") + F.col("n__") / 2) + 0.5) + 1).otherwise(F.col("low__")))
    p = p.withColumn("left__", F.col("seats__") - F.sum("low__").over(group))
    k = p.where("high__ > low__").withColumn("k__", F.explode(F.sequence("low__", F.col("high__") - 1)))
    k = k.withColumn("rank__", F.row_number().over(group.orderBy(F.desc(F.col(votes).cast("double") / (2 * F.col("k__") + 1)), *key)))
    extra = k.where("rank__ <= left__").groupBy(*within, *key).agg(F.count(F.lit(1)).alias("extra__"))
    return p.join(extra, [*within, *key], "left").withColumn(out, F.col("low__") + F.coalesce("extra__", F.lit(0))).drop("seats__", "n__", "sum__", "low__", "high__", "left__", "extra__")


def scramble(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), *parts))


def number(digest: Column) -> Column:
    """The first 32 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def mix(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, size, source_size, target (its source's), taken (words that the mix takes, repeats counted)."""
    sizes = written(sized(docs))
    total = F.floor(F.sum("target").over(Window.partitionBy()) / BLOCK + 0.5)
    sources = targets(sizes).withColumn("blocks", total)
    sources = written(seats(sources.withColumn("all__", F.lit(1)), ["all__"], ["place"], "target", F.col("blocks"), "quota").select("source", "source_size", "place", "target", "quota"))
    shards = F.greatest(F.lit(1), F.least(F.lit(MOST_SHARDS), F.ceil(F.col("source_size") / SHARD)))
    known = small(sources)
    rows = sizes.join(known.withColumnRenamed("source", "of__"), F.col("source").eqNullSafe(F.col("of__")))
    digest = scramble(F.col("name"))
    rows = rows.select("doc_id", "size", "source_size", "place", "target", digest.alias("order__")).withColumn("shard", F.pmod(number(F.col("order__")), shards))
    parts = rows.groupBy("place", "shard").agg(F.sum("size").alias("shard_size"))
    quotas = seats(parts.join(known.select("place", "quota"), "place"), ["place"], ["shard"], "shard_size", F.col("quota"), "shard_blocks")
    quotas = quotas.select("place", "shard", "shard_size", "shard_blocks")
    line = Window.partitionBy("place", "shard").orderBy("order__", "doc_id", "size")
    rows = rows.join(quotas, ["place", "shard"]).withColumn("stop", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    words = F.least(F.col("shard_blocks") * BLOCK, COPIES * F.col("shard_size"))
    start = F.pmod(number(scramble(F.col("place").cast("string"), F.col("shard").cast("string"))), F.ceil(F.col("shard_size") / BLOCK)) * BLOCK
    rows = rows.withColumn("words", words).withColumn("passes", F.expr("coalesce(try_divide(words, shard_size), 0)").cast("long"))
    rows = rows.withColumn("rest", F.col("words") - F.col("passes") * F.col("shard_size")).withColumn("begin", F.when(F.col("shard_size") > 0, start).otherwise(0))
    end = F.col("begin") + F.col("rest")
    first = F.greatest(F.lit(0), F.least(F.col("stop"), end) - F.greatest(F.col("stop") - F.col("size"), F.col("begin")))
    round_ = F.greatest(F.lit(0), F.least(F.col("stop"), end - F.col("shard_size")) - (F.col("stop") - F.col("size")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + first + round_).cast("long").alias("taken"))


#: The same in DuckDB's SQL over the table documents.
SQL = f"""
WITH sizes AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, md5(text), '') AS name, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
own AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM own),
weighed AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS weight FROM placed),
roomy AS (SELECT *, ({COPIES} * source_size)::DOUBLE / weight AS room FROM weighed),
filling AS (
  SELECT *, coalesce(sum({COPIES} * source_size) OVER (ORDER BY room, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS filled,
    (sum(weight) OVER (ORDER BY room, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS waiting,
    (sum(source_size) OVER ())::DOUBLE AS all_words FROM roomy),
levels AS (SELECT *, ({SHARE}::DOUBLE * all_words - filled) / waiting AS step FROM filling),
level AS (SELECT step FROM levels WHERE step <= room ORDER BY room, place LIMIT 1),
aimed AS (SELECT source, source_size, place, least(({COPIES} * source_size)::DOUBLE, (SELECT step FROM level) * weight) AS target FROM levels),
votes AS (
  SELECT *, floor(sum(target) OVER () / {BLOCK} + 0.5)::BIGINT AS seats, count(*) OVER () AS n, sum(target) OVER () AS whole FROM aimed),
bound AS (
  SELECT *, greatest(0, floor(CASE WHEN whole > 0 THEN target / whole ELSE 0 END * (seats - n / 2) + 0.5)::BIGINT - 1) AS low,
    floor(CASE WHEN whole > 0 THEN target / whole ELSE 0 END * (seats + n / 2) + 0.5)::BIGINT + 1 AS high FROM votes),
ranked AS (
  SELECT place, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, place) AS rank
  FROM (SELECT place, target, unnest(range(low, high)) AS k FROM bound WHERE target > 0)),
sources AS (
  SELECT b.source, b.source_size, b.place, b.target,
    b.low + (SELECT count(*) FROM ranked r WHERE r.place = b.place AND r.rank <= b.seats - (SELECT sum(low) FROM bound)) AS quota,
    greatest(1, least({MOST_SHARDS}, ceil(b.source_size / {SHARD})))::BIGINT AS shards FROM bound b),
dealt AS (
  SELECT d.doc_id, d.size, s.source_size, s.place, s.target, s.quota, md5('{SEED}:' || d.name) AS ordered, s.shards
  FROM sizes d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source),
lines AS (SELECT *, ('0x' || substr(ordered, 1, 8))::BIGINT % shards AS shard FROM dealt),
parts AS (SELECT place, shard, any_value(quota) AS seats, sum(size)::BIGINT AS shard_size FROM lines GROUP BY place, shard),
part_votes AS (SELECT *, count(*) OVER (PARTITION BY place) AS n, (sum(shard_size) OVER (PARTITION BY place))::DOUBLE AS whole FROM parts),
part_bound AS (
  SELECT *, greatest(0, floor(CASE WHEN whole > 0 THEN shard_size / whole ELSE 0 END * (seats - n / 2) + 0.5)::BIGINT - 1) AS low,
    floor(CASE WHEN whole > 0 THEN shard_size / whole ELSE 0 END * (seats + n / 2) + 0.5)::BIGINT + 1 AS high FROM part_votes),
part_left AS (SELECT place, any_value(seats) - sum(low) AS remaining FROM part_bound GROUP BY place),
part_ranked AS (
  SELECT place, shard, row_number() OVER (PARTITION BY place ORDER BY shard_size / (2 * k + 1) DESC, shard) AS rank
  FROM (SELECT place, shard, shard_size::DOUBLE AS shard_size, unnest(range(low, high)) AS k FROM part_bound WHERE shard_size > 0)),
part_extra AS (SELECT r.place, r.shard, count(*) AS extra FROM part_ranked r JOIN part_left l USING (place) WHERE r.rank <= l.remaining GROUP BY ALL),
quotas AS (
  SELECT p.place, p.shard, p.shard_size, least((p.low + coalesce(e.extra, 0)) * {BLOCK}, {COPIES} * p.shard_size)::BIGINT AS words
  FROM part_bound p LEFT JOIN part_extra e USING (place, shard)),
laid AS (
  SELECT l.*, q.shard_size, q.words, CASE WHEN q.shard_size > 0 THEN q.words // q.shard_size ELSE 0 END AS passes,
    (sum(l.size) OVER (PARTITION BY place, shard ORDER BY l.ordered, l.doc_id, l.size ROWS UNBOUNDED PRECEDING))::BIGINT AS stop,
    CASE WHEN q.shard_size > 0 THEN ('0x' || substr(md5('{SEED}:' || place || ':' || shard), 1, 8))::BIGINT % ceil(q.shard_size / {BLOCK})::BIGINT * {BLOCK} ELSE 0 END AS start
  FROM lines l JOIN quotas q USING (place, shard)),
cut AS (SELECT *, words - passes * shard_size AS rest FROM laid)
SELECT doc_id, size, source_size, target,
  (passes * size + greatest(0, least(stop, start + rest) - greatest(stop - size, start)) + greatest(0, least(stop, start + rest - shard_size) - (stop - size)))::BIGINT AS taken
FROM cut"""
