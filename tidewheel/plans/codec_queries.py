"""Queries of encodings, lenient values, JSON and wire formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.functions import codec as C
from tidewheel.functions import values as V
from tidewheel.functions import wire as W
from tidewheel.plans.registry import query
from tidewheel.sources.tables import table


@query("hex_encode", "SELECT p_partkey, lower(hex(p_name)) AS h, p_name AS back, lower(to_hex(p_partkey)) AS n, p_partkey AS parsed, NULL::VARCHAR AS odd FROM part")
def _(spark, d):
    b, k = F.col("p_name").cast("binary"), F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", C.hex_encode(b).alias("h"), C.hex_decode(C.hex_encode(b)).cast("string").alias("back"), C.hex_number(k).alias("n"), C.parse_hex(C.hex_number(k)).cast("bigint").alias("parsed"), C.hex_decode(F.lit("abc")).cast("string").alias("odd"))


@query("base64_url", "SELECT p_partkey, rtrim(translate(base64(encode(p_name || '>>?')), '+/', '-_'), '=') AS v FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", C.base64_url(F.concat("p_name", F.lit(">>?")).cast("binary")).alias("v"))


@query("utf8_valid", "SELECT doc_id, true AS whole, false AS cut FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.is_valid_utf8("text").alias("whole"), F.is_valid_utf8(F.concat(F.col("lang").cast("binary"), F.unhex(F.lit("C3"))).cast("string")).alias("cut"))


@query("zigzag", "SELECT o_orderkey, o_orderkey * 2 AS up, CASE WHEN o_orderkey > 0 THEN o_orderkey * 2 - 1 ELSE o_orderkey * -2 END AS down, -o_orderkey AS back FROM orders")
def _(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", C.zigzag(k).alias("up"), C.zigzag(-k).alias("down"), C.unzigzag(C.zigzag(-k)).alias("back"))


def cubed(k):
    """The third power; null beyond a BIGINT, where the SQL of the queries ends with an error."""
    return F.try_multiply(F.try_multiply(k, k), k)


@query("quic_varint", "SELECT o_orderkey, v, CASE WHEN v <= 63 THEN 1 WHEN v <= 16383 THEN 2 WHEN v <= 1073741823 THEN 4 ELSE 8 END AS n, v AS back FROM (SELECT o_orderkey, o_orderkey * o_orderkey * o_orderkey AS v FROM orders)")
def _(spark, d):
    k, v = F.col("o_orderkey"), F.col("v")
    out = table(spark, d, "orders").select("o_orderkey", cubed(k).alias("v")).withColumn("b", C.quic_encode_all(v))
    return out.select("o_orderkey", "v", F.when(k.isNull() | v.isNotNull(), C.quic_length(v)).alias("n"), C.quic_decode_all(F.col("b")).alias("back"))


@query("uvarint", "SELECT o_orderkey, v, greatest(1, ceil(length(bin(v)) / 7.0))::INT AS n, v AS back FROM (SELECT o_orderkey, o_orderkey * o_orderkey * o_orderkey AS v FROM orders)")
def _(spark, d):
    out = table(spark, d, "orders").select("o_orderkey", cubed(F.col("o_orderkey")).alias("v")).withColumn("b", C.uvarint_encode(F.col("v")))
    return out.select("o_orderkey", "v", F.length("b").alias("n"), C.uvarint_decode(F.col("b"))["value"].alias("back"))


#: Fixed values of the two formats: a number, its bytes.
VARINTS = [(0, "00"), (1, "01"), (127, "7f"), (128, "8001"), (300, "ac02"), (16384, "808001"), (2**63 - 1, "ffffffffffffffff7f"), (-1, "ffffffffffffffffff01"), (-(2**63), "80808080808080808001")]
QUIC = [(37, "25"), (15293, "7bbd"), (494878333, "9d7f3e7d"), (151288809941952652, "c2197c5eff14e88c")]


@query("uvarint_bytes", "SELECT * FROM (VALUES " + ", ".join(f"('{x}'::BIGINT, '{h}', '{x}'::BIGINT, {len(h) // 2}, {x % 2**64}::HUGEINT::VARCHAR)" for x, h in VARINTS) + ") t(x, h, back, size, whole)")
def _(spark, d):
    rows = spark.createDataFrame([(x,) for x, _ in VARINTS], "x bigint").withColumn("b", C.uvarint_encode(F.col("x"))).withColumn("r", C.uvarint_decode(F.concat("b", F.unhex(F.lit("ff")))))
    return rows.select("x", C.hex_encode(F.col("b")).alias("h"), F.col("r.value").alias("back"), F.col("r.size").alias("size"), C.unsigned(F.col("r.value")).cast("string").alias("whole"))


@query("uvarint_faults", "SELECT * FROM (VALUES ('', NULL::BIGINT), ('80', NULL), ('ffffffffffffffffff02', NULL), ('8080808080808080808001', NULL), ('ff', NULL), ('05', 5)) t(h, v)")
def _(spark, d):
    rows = spark.createDataFrame([("",), ("80",), ("ffffffffffffffffff02",), ("8080808080808080808001",), ("ff",), ("05",)], "h string")
    return rows.select("h", C.uvarint_decode(F.unhex("h"))["value"].alias("v"))


@query("quic_sequence", "SELECT '" + "".join(h for _, h in QUIC) + "' AS h, '" + ",".join(str(x) for x, _ in QUIC) + "' AS v, 0 AS rest UNION ALL SELECT '25c2', '37', 1 UNION ALL SELECT '', '', 0")
def _(spark, d):
    whole = F.concat(*[C.quic_encode(F.lit(x)) for x, _ in QUIC])
    rows = spark.range(1).select(C.hex_encode(whole).alias("h")).unionByName(spark.createDataFrame([("25c2",), ("",)], "h string")).withColumn("r", C.quic_sequence(F.unhex("h")))
    return rows.select("h", F.array_join(F.transform("r.values", lambda x: x.cast("string")), ",").alias("v"), F.col("r.rest").alias("rest"))


@query("unsigned_words", "SELECT * FROM (VALUES ('ffffffffffffffff', '18446744073709551615', '18446744073709551615'), ('0000000000000001', '1', '72057594037927936'), ('8000000000000000', '9223372036854775808', '128')) t(h, be, le)")
def _(spark, d):
    rows = spark.createDataFrame([("ffffffffffffffff",), ("0000000000000001",), ("8000000000000000",)], "h string")
    b = F.unhex("h")
    return rows.where(C.parse_hex(F.col("h")) == C.load_u64(b, 0)).select("h", C.load_u64(b, 0).cast("string").alias("be"), C.load_u64(b, 0, little=True).cast("string").alias("le"))


PAIRS = [('{"a":1,"a":[2, 3],"b":null}', 'a=1;a=[2, 3];b=null'), (' { "k" : "x\\u0041" } ', 'k="x\\u0041"'), ('{"a":1,oops', 'a=1'), ("[1]", ""), ("{}", "")]


@query("json_pairs", "SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{v}')" for s, v in PAIRS) + ") t(s, v)")
def _(spark, d):
    rows = spark.createDataFrame([(s,) for s, _ in PAIRS], "s string")
    return rows.select("s", F.array_join(F.transform(V.json_pairs(F.col("s")), lambda p: F.concat(p["key"], F.lit("="), p["value"])), ";").alias("v"))


@query("json_escaped", r"""SELECT r_regionkey, '{"id":' || r_regionkey || ',"name":"\u003c' || r_name || '\u0026"}' AS v, '{' || chr(10) || '  "id": ' || r_regionkey || chr(10) || '}' AS indented FROM region""")
def _(spark, d):
    made = V.json_marshalled({"id": F.col("r_regionkey"), "name": F.concat(F.lit("<"), "r_name", F.lit("&")), "gone": F.lit(None).cast("string")})
    return table(spark, d, "region").select("r_regionkey", made.alias("v"), V.json_indented(F.to_json(F.struct(F.col("r_regionkey").alias("id")))).alias("indented"))


@query("json_strict", "SELECT event_id, (props->>'k')::BIGINT AS known, NULL::BIGINT AS unknown FROM events")
def _(spark, d):
    s = F.col("props")
    more = F.regexp_replace(s, r"^\{", '{"z":1,')
    return table(spark, d, "events").select("event_id", V.json_strict(s, "k bigint", ["k"])["k"].alias("known"), V.json_strict(more, "k bigint", ["k"])["k"].alias("unknown"))


@query("type_checks", "SELECT o_orderkey, true AS numeric, false AS text_numeric, false AS same, CASE WHEN o_totalprice = floor(o_totalprice) THEN o_totalprice::BIGINT END AS whole, NULL::BIGINT AS junk FROM orders")
def _(spark, d):
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", V.is_numeric(k).alias("numeric"), V.is_numeric(p).alias("text_numeric"), V.same_type(k, p).alias("same"), V.as_int64(F.col("o_totalprice")).alias("whole"), V.as_int64(p).alias("junk"))


@query("sealed_bodies", "SELECT r_regionkey, r_name AS back, true AS tampered, (12 + length(r_name) + 16)::INTEGER AS n, left(r_name, 3) AS clipped FROM region")
def _(spark, d):
    key, plain = F.lit("0123456789abcdef").cast("binary"), F.col("r_name").cast("binary")
    rows = table(spark, d, "region").withColumn("s", V.sealed(plain, key, F.lit("nonce0000000").cast("binary"), "extra"))
    return rows.select("r_regionkey", V.opened(F.col("s"), key, "extra").cast("string").alias("back"), V.opened(F.col("s"), key, "other").isNull().alias("tampered"), F.octet_length("s").alias("n"), V.clipped(plain, F.lit(3)).cast("string").alias("clipped"))


@query("uuid_forms", "SELECT p_partkey, substr(md5(p_name), 1, 8) || '-' || substr(md5(p_name), 9, 4) || '-' || substr(md5(p_name), 13, 4) || '-' || substr(md5(p_name), 17, 4) || '-' || substr(md5(p_name), 21) AS s, md5(p_name) AS h FROM part")
def _(spark, d):
    s = V.uuid_format(F.unhex(F.md5("p_name")))
    return table(spark, d, "part").select("p_partkey", s.alias("s"), C.hex_encode(V.uuid_bytes(s)).alias("h"))


@query("byte_order", "SELECT o_orderkey, o_orderkey % 65536 AS be16, o_orderkey AS be32, (o_orderkey % 256) * 256 + (o_orderkey // 256) % 256 AS swapped, NULL::BIGINT AS beyond FROM orders")
def _(spark, d):
    k = F.col("o_orderkey")
    b = C.store_be(k, 2)
    return table(spark, d, "orders").select("o_orderkey", C.load_be(b, 0, 2).alias("be16"), C.load_le(C.store_le(k, 4), 0, 4).alias("be32"), C.load_le(b, 0, 2).alias("swapped"), C.load_be(b, 1, 2).alias("beyond"))


@query("bit_gather", "SELECT p_partkey, ((p_size >> 1) & 3) | (((p_size >> 4) & 1) << 2) AS packed FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", C.gather_bits(F.col("p_size").cast("bigint"), 0b10110).cast("int").alias("packed"))


@query("fingerprints", "SELECT p_partkey, rtrim(regexp_replace(sha256(p_name), '(..)', '\\1:', 'g'), ':') AS h, length(sha256(p_name)) AS n FROM part")
def _(spark, d):
    b = F.col("p_name").cast("binary")
    return table(spark, d, "part").select("p_partkey", C.fingerprint_hex(b).alias("h"), F.length(F.sha2(b, 256)).cast("bigint").alias("n"))


@query(
    "word_hash",
    """WITH b AS (SELECT p_partkey, hex(encode(p_name)) AS h, octet_length(encode(p_name)) AS n FROM part),
    w AS (SELECT p_partkey, list_concat([14695981039346656037::UBIGINT],
        list_transform(range(n // 8), lambda i: ('0x' || array_to_string(list_transform(range(8), lambda j: substr(h, ((i * 8 + 7 - j) * 2 + 1)::BIGINT, 2)), ''))::UBIGINT),
        list_transform(range(n // 8 * 8, n), lambda i: ('0x' || substr(h, (i * 2 + 1)::BIGINT, 2))::UBIGINT)) AS words,
      array_to_string(list_transform(range(n), lambda i: printf('%02X', xor(('0x' || substr(h, (i * 2 + 1)::BIGINT, 2))::INTEGER, (4 - i % 4)::INTEGER))), '') AS masked FROM b),
    f AS (SELECT p_partkey, masked, list_reduce(words, lambda a, x: (xor(a, x)::HUGEINT * 1099511628211 % 18446744073709551616)::UBIGINT) AS v FROM w)
    SELECT p_partkey, CASE WHEN v >= 9223372036854775808 THEN (v::HUGEINT - 18446744073709551616)::BIGINT ELSE v::BIGINT END AS h, masked FROM f""",
)
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", C.fnv_words(F.col("p_name").cast("binary")).alias("h"), F.hex(C.xor_mask(F.col("p_name").cast("binary"), F.lit(0x01020304))).alias("masked"))


@query("lenient_numbers", "SELECT event_id, event_id AS plain, event_id AS quoted, 0::BIGINT AS empty, NULL::BIGINT AS junk, value AS real, '\"' || event_id || '\"' AS out FROM events")
def _(spark, d):
    i = F.col("event_id").cast("string")
    return table(spark, d, "events").select("event_id", V.lenient(i, "bigint").alias("plain"), V.lenient(V.quoted(F.col("event_id")), "bigint").alias("quoted"), V.lenient(F.lit(""), "bigint").alias("empty"), V.lenient(F.col("event_type"), "bigint").alias("junk"), V.lenient(F.col("value").cast("string"), "double").alias("real"), V.quoted(F.col("event_id")).alias("out"))


@query("bool_int", "SELECT * FROM (VALUES ('1', true), ('0', false), ('true', true), ('\"1\"', true), ('null', false), ('junk', false), ('-3', true), ('', false)) t(s, v)")
def _(spark, d):
    rows = ["1", "0", "true", '"1"', "null", "junk", "-3", ""]
    return spark.createDataFrame([(x,) for x in rows], "s string").select("s", V.bool_int(F.col("s")).alias("v"))


@query("json_entries", "SELECT event_id, 'k' AS key, props->>'k' AS value FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.explode(V.json_entries(F.col("props"))))


@query("json_elements", "SELECT event_id, unnest([0, 1]) AS pos, unnest([props->>'k', event_type]) AS col FROM events")
def _(spark, d):
    s = F.concat(F.lit("["), F.get_json_object("props", "$.k"), F.lit(',"'), "event_type", F.lit('"]'))
    return table(spark, d, "events").select("event_id", F.posexplode(V.json_elements(s)))


@query("json_typed", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def _(spark, d):
    s = F.replace("props", F.lit('"k"'), F.lit('"K"'))
    return table(spark, d, "events").select("event_id", V.json_typed(s, "k bigint", ["k"])["k"].alias("k"))


@query("json_marshal", "SELECT r_regionkey, '{\"id\":' || r_regionkey || ',\"name\":\"' || r_name || '\"}' AS j, true AS valid, false AS broken FROM region")
def _(spark, d):
    j = F.to_json(F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("gone")))
    return table(spark, d, "region").select("r_regionkey", j.alias("j"), V.json_valid(j).alias("valid"), V.json_valid(F.concat(j, F.lit("}"))).alias("broken"))


@query("json_compact", "SELECT event_id, replace(props, ' ', '') AS v FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", V.json_compact(F.col("props")).alias("v"))


@query("wire_round_trip", "SELECT o_orderkey, o_orderkey AS k, -o_orderkey AS s, o_orderpriority AS p, o_totalprice AS f FROM orders")
def _(spark, d):
    m = F.concat(W.field(F.col("o_orderkey"), 1, "varint"), W.field(-F.col("o_orderkey"), 2, "sint"), W.field(F.col("o_orderpriority"), 3, "string"), W.field(F.col("o_totalprice"), 4, "float64"))
    out = table(spark, d, "orders").select("o_orderkey", m.alias("m"), "o_totalprice").withColumn("f", W.scan(F.col("m")))
    by = {n: F.get(F.filter("f", (lambda num: lambda x: x["num"] == num)(n)), F.lit(0)) for n in (1, 2, 3, 4)}
    out = out.select("o_orderkey", W.signed(by[1]["raw"]).alias("k"), W.unzigzagged(by[2]["raw"]).alias("s"), by[3]["data"].cast("string").alias("p"), C.store_le(W.signed(by[4]["raw"]), 8).alias("b"))
    return out.select("o_orderkey", "k", "s", "p", W.unpack_struct(F.col("b"), {"f": "d"})["f"].alias("f"))


#: Fixed values of the wire format: what is encoded, its bytes.
WIRE = [
    ("varint 150", "089601"),
    ("varint -1", "08ffffffffffffffffff01"),
    ("sint -2", "1003"),
    ("string testing", "120774657374696e67"),
    ("float64 1.5", "19000000000000f83f"),
    ("fixed32 1", "2501000000"),
    ("packed 3, 270, 86942", "3206038e029ea705"),
    ("entry a: 7", "3a050a01611007"),
]


@query("wire_bytes", "SELECT * FROM (VALUES " + ", ".join(f"('{x}', '{h}')" for x, h in WIRE) + ") t(x, h)")
def _(spark, d):
    made = [
        W.field(F.lit(150), 1, "varint"),
        W.field(F.lit(-1), 1, "varint"),
        W.field(F.lit(-2), 2, "sint"),
        W.field(F.lit("testing"), 2, "string"),
        W.field(F.lit(1.5), 3, "float64"),
        W.field(F.lit(1), 4, "fixed32"),
        W.packed(F.array(*[F.lit(x) for x in (3, 270, 86942)]), 6, "varint"),
        W.map_entry(7, W.field(F.lit("a"), 1, "string"), W.field(F.lit(7), 2, "varint")),
    ]
    rows = F.array(*[F.struct(F.lit(x).alias("x"), C.hex_encode(m).alias("h")) for (x, _), m in zip(WIRE, made, strict=True)])
    return spark.range(1).select(F.inline(rows))


@query("wire_packed", "SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM events GROUP BY user_id")
def _(spark, d):
    groups = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("ids"))
    m = W.find(W.packed(F.col("ids"), 5, "varint"), 5)["data"]
    return groups.select("user_id", F.array_join(F.transform(W.unpacked(m, "varint"), lambda x: x.cast("string")), ",").alias("ids"))


@query("wire_map", "SELECT p_partkey, p_name AS k, p_size::BIGINT AS v, p_name AS nested FROM part")
def _(spark, d):
    entry = W.map_entry(7, W.field(F.col("p_name"), 1, "string"), W.field(F.col("p_size"), 2, "varint"))
    out = table(spark, d, "part").select("p_partkey", entry.alias("m"))
    e = F.get(W.map_entries(F.col("m"), 7), F.lit(0))
    return out.select("p_partkey", e["key"]["data"].cast("string").alias("k"), W.signed(e["value"]["raw"]).alias("v"), W.find_path(F.col("m"), 7, 1)["data"].cast("string").alias("nested"))


@query("fixed_struct", "SELECT p_partkey, p_size AS size, p_retailprice AS price FROM part")
def _(spark, d):
    b = W.pack_struct([F.col("p_size"), F.col("p_retailprice")], "Hd", ">")
    out = table(spark, d, "part").select("p_partkey", W.unpack_struct(b, {"size": "H", "price": "d"}, ">").alias("x"))
    return out.select("p_partkey", "x.size", "x.price")
