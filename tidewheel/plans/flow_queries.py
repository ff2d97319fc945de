"""Queries of ordered dataflow, keyed lookup, sets, prefixes, bits and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewheel.functions import values as V
from tidewheel.operators import bits, components, dataflow, prefix, stateful
from tidewheel.plans.registry import query
from tidewheel.sources.tables import table


@query("stream_filter_map_take", "SELECT event_id, round(value * 10, 6) AS v FROM events WHERE event_id % 2 = 0 ORDER BY event_id LIMIT 3")
def _(spark, d):
    ev = table(spark, d, "events").where("event_id % 2 = 0").select("event_id", F.round(F.col("value") * 10, 6).alias("v"))
    return dataflow.take(ev, 3, "event_id")


@query("map_values", "SELECT event_id, round(value * 2 + 1, 6) AS v FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.round(F.col("value") * 2 + 1, 6).alias("v"))


@query("flat_map_words", "SELECT p_partkey, i - 1 AS pos, w[i] AS word FROM (SELECT p_partkey, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part))")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "word")).withColumn("pos", F.col("pos").cast("bigint"))


@query("filter_events", "SELECT event_id, event_type FROM events WHERE value >= 50 AND event_type <> 'click'")
def _(spark, d):
    return table(spark, d, "events").where(F.coalesce((F.col("value") >= 50) & (F.col("event_type") != "click"), F.lit(False))).select("event_id", "event_type")


@query("any_all", "SELECT user_id, coalesce(bool_or(value > 90), false) AS any_big, coalesce(bool_and(value > 1), true) AS all_some FROM events GROUP BY user_id")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(dataflow.any_match(F.col("value") > 90).alias("any_big"), dataflow.all_match(F.col("value") > 1).alias("all_some"))


@query("find_first", "SELECT user_id, min(event_id) FILTER (event_type = 'purchase') AS first_purchase FROM events GROUP BY user_id")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(dataflow.find_first(F.col("event_id"), F.col("event_type") == "purchase", F.col("event_id")).alias("first_purchase"))


@query("contains", "SELECT event_id, event_type IN ('view', 'click') AS hit FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.col("event_type").isin("view", "click").alias("hit"))


@query("range_half_open", "SELECT event_id, value FROM events WHERE value >= 10 AND value < 20")
def _(spark, d):
    return table(spark, d, "events").where(dataflow.half_open(F.col("value"), F.lit(10), F.lit(20))).select("event_id", "value")


@query("range_stride", "SELECT r_regionkey, unnest(range(0, r_regionkey * 3, 2)) AS v FROM region")
def _(spark, d):
    return table(spark, d, "region").select("r_regionkey", F.explode(dataflow.stride(F.lit(0), F.col("r_regionkey") * 3, F.lit(2))).alias("v"))


@query("coalesce_zero", "SELECT p_partkey, coalesce(nullif(p_size % 3, 0), nullif(p_size % 2, 0), 0) AS v FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", V.coalesce_zero(0, F.col("p_size") % 3, F.col("p_size") % 2).alias("v"))


@query("ternary_zero_null", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS kind, p_size % 5 = 0 AS is_zero, nullif(p_size % 5, 0) AS pointer, coalesce(nullif(p_size % 5, 0), 9) AS deref_or FROM part")
def _(spark, d):
    r = F.col("p_size") % 5
    return table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 25, "large").otherwise("small").alias("kind"), (r == 0).alias("is_zero"), F.nullif(r, F.lit(0)).alias("pointer"), F.coalesce(F.nullif(r, F.lit(0)), F.lit(9)).alias("deref_or"))


@query("optional_chain", "SELECT event_id, coalesce(CASE WHEN k * 2 > 50 THEN k * 2 END, -1) AS v FROM (SELECT event_id, (props->>'k')::BIGINT AS k FROM events)")
def _(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint") * 2
    return table(spark, d, "events").select("event_id", F.coalesce(F.when(k > 50, k), F.lit(-1)).cast("bigint").alias("v"))


@query("result_recover", "SELECT o_orderkey, try_cast(substr(o_orderpriority, 1, 1) AS INT) AS value, CASE WHEN try_cast(substr(o_orderpriority, 1, 1) AS INT) IS NULL THEN 'no number' END AS error, coalesce(try_cast(o_orderstatus AS INT), 0) AS recovered FROM orders")
def _(spark, d):
    r = V.result(F.substring("o_orderpriority", 1, 1).try_cast("int"), "no number")
    other = V.recovered(V.result(F.col("o_orderstatus").try_cast("int"), "x"), F.lit(0))
    return table(spark, d, "orders").select("o_orderkey", r["value"].alias("value"), r["error"].alias("error"), other["value"].alias("recovered"))


@query("either_fold", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'L' || event_type ELSE 'R' || round(value, 1)::VARCHAR END AS v, CASE WHEN event_type = 'error' THEN 'right' ELSE 'left' END AS swapped FROM events")
def _(spark, d):
    e = V.either(F.col("event_type") != "error", F.col("event_type"), F.round("value", 1))
    out = table(spark, d, "events").withColumn("e", e)
    return out.select("event_id", V.either_fold(F.col("e"), lambda x: F.concat(F.lit("L"), x), lambda x: F.concat(F.lit("R"), x.cast("string"))).alias("v"), V.either_swap(F.col("e"))["tag"].alias("swapped"))


@query("group_by_collect", "SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM events GROUP BY user_id")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(dataflow.collected("event_id", "event_id"), ",").alias("ids"))


@query("reduce_fold", "SELECT user_id, round(list_reduce(list(value ORDER BY event_id), lambda a, b: a * 0.5 + b, 1.0::DOUBLE), 6) AS v FROM events GROUP BY user_id")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.round(dataflow.fold("value", "event_id", F.lit(1.0), lambda a, x: a * 0.5 + x), 6).alias("v"))


@query("count_rows", "SELECT count(*) AS n, count(*) FILTER (event_type = 'view') AS views FROM events")
def _(spark, d):
    return table(spark, d, "events").agg(F.count("*").alias("n"), F.count(F.when(F.col("event_type") == "view", 1)).alias("views"))


@query("unique_ordered", "SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS types FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY user_id")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(dataflow.unique_ordered("event_type", "event_id"), ",").alias("types"))


@query("distinct_first", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def _(spark, d):
    return dataflow.distinct_first(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query("index_by_last", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def _(spark, d):
    return dataflow.index_last(table(spark, d, "events"), ["user_id"], "event_type", "event_id")


@query("map_keys_values", "SELECT event_id, 'k' AS keys, props->>'k' AS vals FROM events")
def _(spark, d):
    m = V.json_entries(F.col("props"))
    return table(spark, d, "events").select("event_id", F.array_join(F.map_keys(m), ",").alias("keys"), F.array_join(F.map_values(m), ",").alias("vals"))


@query("batch_lookup", "SELECT o.o_orderkey, c.c_name AS value, CASE WHEN c.c_custkey IS NULL THEN 'missing' END AS error FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey")
def _(spark, d):
    probes = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return dataflow.batch_lookup(probes, table(spark, d, "customer").where("c_acctbal > 0"), "c_custkey", "c_name").select("o_orderkey", "value", "error")


@query("single_flight", "SELECT e.event_id, t.total FROM events e JOIN (SELECT user_id, user_id * user_id AS total FROM (SELECT DISTINCT user_id FROM events)) t USING (user_id)")
def _(spark, d):
    return dataflow.single_flight(table(spark, d, "events"), "user_id", lambda k: k.withColumn("total", F.col("user_id") * F.col("user_id"))).select("event_id", "total")


def _buyers(spark, d, kind):
    return table(spark, d, "events").where(F.col("event_type") == kind).select("user_id")


for _name, _f, _sql in (
    ("set_intersect", dataflow.set_intersect, "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type = 'error'"),
    ("set_difference", dataflow.set_difference, "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type = 'purchase' EXCEPT SELECT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type = 'error'"),
    ("symmetric_difference", dataflow.symmetric_difference, "(SELECT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type = 'purchase' EXCEPT SELECT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type = 'error') UNION ALL (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type = 'error' EXCEPT SELECT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type = 'purchase')"),
):

    def _set(spark, d, f=_f):
        ev = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
        return f(ev.where("event_type = 'purchase'"), ev.where("event_type = 'error'"), ["user_id", "day"])

    query(_name, _sql)(_set)


@query("set_union", "SELECT user_id FROM events WHERE event_type = 'purchase' UNION SELECT user_id FROM events WHERE event_type = 'error'")
def _(spark, d):
    return _buyers(spark, d, "purchase").union(_buyers(spark, d, "error")).distinct()


@query("list_concat", "SELECT user_id FROM events WHERE event_type = 'purchase' UNION ALL SELECT user_id FROM events WHERE event_type = 'error'")
def _(spark, d):
    return _buyers(spark, d, "purchase").unionByName(_buyers(spark, d, "error"))


@query("set_has", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("longest_prefix", "SELECT p.p_partkey, (SELECT k.key FROM keys k WHERE starts_with(p.p_name, k.key) ORDER BY length(k.key) DESC LIMIT 1) AS found FROM part p".replace("FROM keys k", "FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS key FROM part UNION SELECT DISTINCT p_name FROM part) k"))
def _(spark, d):
    part = table(spark, d, "part")
    keys = part.select(F.substring_index("p_name", " ", 1).alias("key")).union(part.select("p_name"))
    return prefix.longest_prefix(part, "p_name", keys, "key").select("p_partkey", "found")


@query("walk_prefix", "SELECT p_name, p_partkey FROM part WHERE starts_with(p_name, 'red')")
def _(spark, d):
    return prefix.walk_prefix(table(spark, d, "part"), "p_name", "red").select("p_name", "p_partkey")


@query("has_prefix", "SELECT q AS probe, coalesce(q = '' OR EXISTS (SELECT 1 FROM part WHERE starts_with(p_name, q)), false) AS has FROM (VALUES (''), ('re'), ('red'), ('zzz'), ('small r')) t(q)")
def _(spark, d):
    probes = spark.createDataFrame([("",), ("re",), ("red",), ("zzz",), ("small r",)], "probe string")
    out = prefix.has_prefix(probes, "probe", table(spark, d, "part"), "p_name")
    return out.withColumn("has", F.coalesce("has", F.lit(False)))


@query("ordered_map", "SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def _(spark, d):
    return prefix.last_writes(table(spark, d, "events"), "user_id", "value", "event_id", F.col("event_type") == "error")


@query("connected_components", "SELECT doc_id AS node, min(doc_id) OVER (PARTITION BY text) AS component, count(*) OVER (PARTITION BY text) AS size FROM documents QUALIFY count(*) OVER (PARTITION BY text) > 1")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    w = Window.partitionBy(F.sha2("text", 256)).orderBy("doc_id")
    links = docs.select(F.col("doc_id").alias("a"), F.lag("doc_id").over(w).alias("b")).where("b is not null")
    return components.labelled(links)


@query("components_bipartite")
def _(spark, d):
    li = table(spark, d, "lineitem")
    o, p = F.col("l_orderkey"), F.col("l_partkey")
    if li.where(" OR ".join(f"{k} >= {1 << 62} OR {k} < {-(1 << 62)}" for k in ("l_orderkey", "l_partkey"))).isEmpty():
        # 63 bits hold every key: nodes are whole numbers, orders even and parts odd
        roots = components.components(li.select(F.shiftleft(o.cast("bigint"), 1).alias("a"), F.shiftleft(p.cast("bigint"), 1).bitwiseOR(F.lit(1).cast("bigint")).alias("b")))
        name = F.concat(F.when(F.col("node") % 2 == 0, "o").otherwise("p"), F.shiftright("node", 1).cast("string"))
        return components.sized(roots.select(name.alias("node"), "root"))
    return components.labelled(li.select(F.concat(F.lit("o"), o).alias("a"), F.concat(F.lit("p"), p).alias("b")))


@query("chunked", "SELECT user_id, chunk, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 7 AS chunk FROM events) GROUP BY ALL")
def _(spark, d):
    c = dataflow.chunked(table(spark, d, "events"), 7, ["user_id"], "event_id")
    return c.groupBy("user_id", "chunk").agg(F.array_join(dataflow.collected("event_id", "event_id"), ",").alias("ids"))


@query("chunk_arrays", "SELECT p_partkey, list_aggregate(list_transform(range(0, len(w), 2), lambda i: array_to_string(w[i + 1:i + 2], '+')), 'string_agg', '|') AS parts FROM (SELECT p_partkey, string_split(p_type || ' ' || p_name || ' ' || p_brand, ' ') AS w FROM part)")
def _(spark, d):
    w = F.split(F.concat_ws(" ", "p_type", "p_name", "p_brand"), " ")
    return table(spark, d, "part").withColumn("w", w).select("p_partkey", F.array_join(F.transform(dataflow.chunk_array(F.col("w"), 2), lambda x: F.array_join(x, "+")), "|").alias("parts"))


@query("sliding_frame", "SELECT event_id, round(avg(value) OVER w, 6) AS mean3, first_value(event_id) OVER w AS front, last_value(event_id) OVER w AS back FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-2, 0)
    return table(spark, d, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("mean3"), F.first("event_id").over(w).alias("front"), F.last("event_id").over(w).alias("back"))


@query("sample_every", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events) WHERE n = 0 OR n < 3 OR n % 10 = 0")
def _(spark, d):
    return dataflow.sometimes(table(spark, d, "events"), ["user_id"], ["event_id"], first=3, every=10).select("event_id")


@query("round_robin", "SELECT event_id, ['a', 'b', 'c'][((row_number() OVER (ORDER BY event_id) - 1) % 3 + 1)::INT] AS assigned FROM events")
def _(spark, d):
    return dataflow.round_robin(table(spark, d, "events").select("event_id"), ["a", "b", "c"], ["event_id"]).select("event_id", "assigned")


@query("take", "SELECT event_id, value FROM events ORDER BY event_id LIMIT 25")
def _(spark, d):
    return dataflow.take(table(spark, d, "events").select("event_id", "value"), 25, "event_id")


@query("drop_take", "SELECT event_id, value FROM events ORDER BY event_id LIMIT 25 OFFSET 100")
def _(spark, d):
    return table(spark, d, "events").select("event_id", "value").orderBy("event_id").offset(100).limit(25)


@query("first_row", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 1")
def _(spark, d):
    return dataflow.take(table(spark, d, "events").select("event_id", "event_type"), 1, "event_id")


@query("heap_topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey LIMIT 10")
def _(spark, d):
    return dataflow.take(table(spark, d, "lineitem"), 10, "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("heap_peek_by_key", "SELECT l_suppkey, min(l_extendedprice) AS lowest FROM lineitem GROUP BY l_suppkey")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.min_by("l_extendedprice", "l_extendedprice").alias("lowest"))


@query("heap_drain", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal, s_suppkey")
def _(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", "s_acctbal").orderBy("s_acctbal", "s_suppkey")


@query("backward", "SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id DESC) AS ids FROM events GROUP BY user_id")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.reverse(dataflow.collected("event_id", "event_id")), ",").alias("ids"))


@query("list_edits", "SELECT r_regionkey, 'first,' || r_name || ',mid,last' AS items FROM region")
def _(spark, d):
    a = F.array_insert(F.array_append(F.array_prepend(F.array("r_name"), "first"), "last"), 3, "mid")
    return table(spark, d, "region").select("r_regionkey", F.array_join(a, ",").alias("items"))


@query("lru_final", "SELECT user_id, used, row_number() OVER (ORDER BY used DESC) AS position FROM (SELECT user_id, max(event_id) AS used FROM events GROUP BY user_id) QUALIFY position <= 20")
def _(spark, d):
    return dataflow.recency(table(spark, d, "events"), "user_id", "event_id", 20)


@query("bitset_algebra", "SELECT a.l_suppkey, a.b & b.b AS both, a.b | b.b AS either, xor(a.b, b.b) AS one, a.b & ~b.b AS only_a, bit_count(a.b)::BIGINT AS n FROM (SELECT l_suppkey, bit_or(1::BIGINT << l_linenumber) AS b FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a JOIN (SELECT l_suppkey, bit_or(1::BIGINT << l_linenumber) AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b USING (l_suppkey)")
def _(spark, d):
    li = table(spark, d, "lineitem")
    a = li.where("l_returnflag = 'A'").groupBy("l_suppkey").agg(F.bit_or(bits.bit(F.col("l_linenumber"))).alias("a"))
    b = li.where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.bit_or(bits.bit(F.col("l_linenumber"))).alias("b"))
    return a.join(b, "l_suppkey").selectExpr("l_suppkey", "a & b as both", "a | b as either", "a ^ b as one", "a & ~b as only_a", "cast(bit_count(a) as bigint) as n")


@query("bit_updates", "SELECT p_partkey, p_size | (1::BIGINT << 40) AS with_bit, p_size & ~(1::BIGINT << 1) AS without_bit, xor(p_size::BIGINT, 4::BIGINT) AS toggled, p_size & 2 <> 0 AS has, ~p_size::BIGINT & 255 AS complement FROM part")
def _(spark, d):
    x = F.col("p_size").cast("bigint")
    return table(spark, d, "part").select("p_partkey", bits.with_bit(x, F.lit(40)).alias("with_bit"), bits.without_bit(x, F.lit(1)).alias("without_bit"), bits.toggled(x, F.lit(2)).alias("toggled"), bits.has_bit(x, F.lit(1)).alias("has"), bits.complement(x, 8).alias("complement"))


@query("bit_positions", "SELECT p_partkey, array_to_string(list_filter(range(0, 16), lambda i: p_size & (1 << i)::INT <> 0), ',') AS positions, coalesce(list_min(list_filter(range(0, 16), lambda i: p_size & (1 << i)::INT <> 0 AND i >= 2)), -1) AS next_set, coalesce(list_min(list_filter(range(0, 16), lambda i: p_size & (1 << i)::INT = 0 AND i >= 2)), -1) AS next_clear FROM part")
def _(spark, d):
    x = F.col("p_size").cast("bigint")
    return table(spark, d, "part").select("p_partkey", F.array_join(bits.positions(x, 16).cast("array<string>"), ",").alias("positions"), bits.next_set(x, F.lit(2), 16).cast("bigint").alias("next_set"), bits.next_clear(x, F.lit(2), 16).cast("bigint").alias("next_clear"))


@query("bitmap_cardinality", "SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_suppkey")
def _(spark, d):
    return bits.cardinality(bits.bitmap(table(spark, d, "lineitem"), ["l_suppkey"], "l_partkey"), ["l_suppkey"])


@query("zero_counts", "SELECT p_partkey, length(bin(p_size)) - length(rtrim(bin(p_size), '0')) AS trailing, 64 - length(bin(p_size)) AS leading FROM part WHERE p_size > 0")
def _(spark, d):
    x = F.col("p_size").cast("bigint")
    return table(spark, d, "part").where("p_size > 0").select("p_partkey", bits.trailing_zeros(x).cast("bigint").alias("trailing"), bits.leading_zeros(x).cast("bigint").alias("leading"))


@query("ewma", "SELECT user_id, round(list_reduce(list(value ORDER BY event_id), lambda a, b: a * 0.9 + b * (1 - 0.9)), 6) AS v FROM events GROUP BY user_id")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.round(stateful.smoothed("value", "event_id"), 6).alias("v"))


@query("rollup_extra", "SELECT n_regionkey, n_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)")
def _(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.rollup("n_regionkey", "n_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("as_of_extra", "SELECT e.event_id, p.event_id AS purchase FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts")
    return table(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("purchase"))
