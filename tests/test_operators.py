"""Operators without SQL against plain models, and literal examples."""

import random

from pyspark.sql import functions as F

from tidewheel.functions import codec, dns, text, values, wire
from tidewheel.operators import components, dataflow, rules, stateful
from tidewheel.streaming import admission


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_components_of_random_links(spark):
    r = random.Random(5)
    links = [(r.randrange(120), r.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 220)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.node: x.component for x in components.labelled(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {x: find(x) for x in parent}


def test_components_of_no_links(spark):
    assert components.labelled(spark.createDataFrame([], "a int, b int")).count() == 0


def model(rows, rule):
    state, out = {}, []
    for key, at, tie in sorted(rows, key=lambda x: (x[1], x[2])):
        ok, state[key] = rule.step(state.get(key, rule.first()), at)
        if ok:
            out.append(tie)
    return sorted(out)


def test_admission_batch_stream_and_model_agree(spark, tmp_path):
    r = random.Random(9)
    rows = [(r.randrange(3), r.randrange(400) * 1_000_000, i) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, at bigint, tie bigint")
    df.write.parquet(str(tmp_path / "in"))
    for i, (rule, batch) in enumerate((
        (admission.Throttle(9_000_000), lambda d: stateful.throttle(d, ["k"], "at", "tie", 9_000_000)),
        (admission.SlidingWindow(3, 20_000_000), lambda d: stateful.sliding_window(d, ["k"], "at", "tie", 3, 20_000_000)),
        (admission.TokenBucket(0.25, 4), lambda d: stateful.token_bucket(d, ["k"], "at", "tie", 0.25, 4)),
    )):
        want = model(rows, rule)
        assert sorted(x.tie for x in batch(df).collect()) == want
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        q = admission.admitted(stream, "k", "at", "tie", rule).writeStream.format("memory").queryName(f"adm{i}").option("checkpointLocation", str(tmp_path / f"c{i}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(x.tie for x in spark.table(f"adm{i}").collect()) == want


def test_breaker_opens_probes_and_closes(spark):
    rows = [(1, t * 10, i, bad) for i, (t, bad) in enumerate([(0, True), (1, True), (2, False), (12, False), (13, True)])]
    df = spark.createDataFrame(rows, "k int, at bigint, tie int, bad boolean")
    out = stateful.breaker(df, ["k"], "at", "tie", "bad", 1000, 2, 0.5, 100).orderBy("tie").collect()
    assert [(x.admitted, x.state) for x in out] == [(True, "closed"), (True, "open"), (False, "open"), (True, "closed"), (True, "closed")]


def test_breaker_judges_successes_and_waits_longer_than_the_cooldown(spark):
    calls = [(0, True), (1, False), (2, False), (101, False), (102, False), (103, None)]
    df = spark.createDataFrame([(None, t, i, bad) for i, (t, bad) in enumerate(calls)], "k int, at bigint, tie int, bad boolean")
    out = stateful.breaker(df, ["k"], "at", "tie", "bad", 1000, 2, 0.5, 100).orderBy("tie").collect()
    assert [(x.admitted, x.state) for x in out] == [(True, "closed"), (True, "open"), (False, "open"), (False, "open"), (True, "closed"), (True, "closed")]


def test_one_key_with_a_third_of_all_rows(spark):
    """A key that never pauses goes through one task in batches; nothing is lost and order holds."""
    rows = spark.range(60_000).selectExpr("if(id % 3 = 0, 0, id) as k", "id * 10 as at", "id as tie", "id % 7 = 0 as bad", "if(id % 2 = 0, 'a', 'b') as event")
    assert stateful.throttle(rows, ["k"], "at", "tie", 300).where("k = 0").count() == 2_000
    assert stateful.sliding_window(rows, ["k"], "at", "tie", 2, 300).where("k = 0").count() == 4_000
    assert stateful.breaker(rows, ["k"], "at", "tie", "bad", 10_000, 5, 0.99, 10).where("k = 0").count() == 20_000
    got = stateful.machine(rows, ["k"], "at", "tie", "event", {("x", "a"): "y", ("y", "b"): "x"}, "x")
    assert tuple(got.where("k = 0").first()) == (0, "x", 20_000, 0) and got.count() == 40_001
    replies = rows.where("id % 30 = 0" if "id" in rows.columns else "tie % 30 = 0").selectExpr("k", "at as reply_at")
    found = stateful.correlate(rows.select("k", "at", "tie"), replies, "k", "at", "reply_at", 100).where("k = 0 and replied is not null")
    assert found.count() == sum((-t % 30) * 10 < 100 and t + (-t % 30) < 60_000 for t in range(0, 60_000, 3))


def test_chunk_sizes(spark):
    df = spark.range(1, 6)
    assert [x.chunk for x in dataflow.chunked(df, 2, [], "id").orderBy("id").collect()] == [0, 0, 1, 1, 2]
    assert dataflow.chunked(df, 0, [], "id").count() == 0
    assert one(spark, dataflow.chunk_array(F.array(*map(F.lit, (1, 2, 3))), 0)) == [[1], [2], [3]]


def test_literal_examples(spark):
    assert one(spark, text.snake(F.lit("HTTPServerURL"))) == "http_server_url"
    assert one(spark, text.kebab(F.lit("a--b"))) == "a-b"
    assert one(spark, text.scan_tokens(F.lit('gzip, deflate, br, "quoted,token,intact", zstd,  '))) == ["gzip", "deflate", "br", '"quoted,token,intact"', "zstd"]
    assert one(spark, text.slice_once(F.lit("ab--cd"), "--", 2)) == ["ab--", "cd"]
    assert one(spark, text.parse_uint(F.lit("18446744073709551616"))) is None
    assert str(one(spark, values.parse_rfc3339(F.lit("2024-02-29t10:11:60.5+01:00")))) == "2024-02-29 09:11:59.500000"
    assert one(spark, values.parse_rfc3339(F.lit("2024-02-29"))) is None
    assert str(one(spark, values.parse_http_date(F.lit("Sun, 06 Nov 1994 08:49:37 GMT")))) == "1994-11-06 08:49:37"


def test_json_validity(spark):
    given = spark.createDataFrame([('{"a":1}',), ('{"a":1}}',), ("[1,]",), ('{"a":1,"a":2}',), ("NaN",)], "s string")
    assert [x.v for x in given.select(values.json_valid("s").alias("v")).collect()] == [True, False, False, True, False]


def test_number_encodings_round_trip(spark):
    numbers = [0, 1, 63, 64, 127, 128, 16383, 16384, 1 << 30, (1 << 40) + 7, (1 << 61) + 5]
    df = spark.createDataFrame([(x,) for x in numbers], "x bigint")
    c = F.col("x")
    for x in df.select("x", codec.quic_decode(codec.quic_encode(c)).alias("q"), codec.uvarint_decode(codec.uvarint_encode(c)).alias("u"), codec.unzigzag(codec.zigzag(-c)).alias("z"), codec.gather_bits(codec.spread_bits(c, (1 << 62) - 1), (1 << 62) - 1).alias("g")).collect():
        assert x.q.value == x.u.value == -x.z == x.g == x.x


def test_wire_errors_and_nesting(spark):
    inner = wire.write_varint(1 << 3 | 2) + b"\x02\xff\xff"
    good = wire.write_varint(4 << 3 | 2) + wire.write_varint(len(inner)) + inner
    df = spark.createDataFrame([(bytearray(good),), (bytearray(good[:-1]),), (None,)], "b binary")
    out = df.select(wire.scan("b").alias("s"), wire.fault("b").alias("e"), wire.walk("b").alias("w"), wire.find_path(F.col("b"), 4, 1).alias("f")).collect()
    assert bytes(out[0].f.data) == b"\xff\xff"
    assert [x.path for x in out[0].w] == ["4", "4.1"]
    assert out[1].s == [] and out[1].e and out[0].e is None and out[2].s is None
    tail = spark.createDataFrame([(bytearray(good + b"\x08"),)], "b binary").select(wire.scan("b").alias("s"), wire.fault("b").alias("e")).first()
    assert [x.num for x in tail.s] == [4] and tail.e


def test_dns_answers(spark):
    message = bytes.fromhex("123481800001000100000000") + b"\x07example\x03com\0\0\x01\0\x01" + bytes.fromhex("c00c000100010000012c0004") + bytes([8, 8, 4, 4])
    df = spark.createDataFrame([(bytearray(message),), (bytearray(message[:-1]),)], "b binary")
    out = [x.a for x in df.select(dns.answers("b").alias("a")).collect()]
    assert [(x.name, x.ttl, x.value) for x in out[0]] == [("example.com", 300, "8.8.4.4")]
    assert out[1] is None
    svcb = bytes.fromhex("0001") + b"\0" + bytes.fromhex("000100030268320003000201bb")
    got = spark.createDataFrame([(bytearray(svcb),)], "b binary").select(dns.service_binding("b").alias("s")).first().s
    assert (got.priority, got.parameters) == (1, {"alpn": "h2", "port": "443"})


def test_once_per_key_and_sessions_stream(spark, sf, tmp_path):
    ev = spark.read.parquet(f"{sf}/events.parquet").withColumn("t", F.col("ts").cast("timestamp"))
    ev.write.parquet(str(tmp_path / "in"))
    for i, (f, mode) in enumerate(((lambda s: admission.once_per_key(s, ["user_id"], "t", "60 days").select("user_id"), "append"), (lambda s: admission.debounced(s, "user_id", "t", "6 hours", "1 hour"), "append"))):
        stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
        q = f(stream).writeStream.format("memory").queryName(f"st{i}").outputMode(mode).option("checkpointLocation", str(tmp_path / f"k{i}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("st0").count() == ev.select("user_id").distinct().count()
    assert spark.table("st1").count() > 0


def test_json_lines_and_listing(spark, sf, tmp_path):
    from tidewheel.sources import files

    df = spark.read.parquet(f"{sf}/region.parquet")
    files.write_json_lines(df, str(tmp_path / "j"), "gzip")
    back = files.read_json_lines(spark, str(tmp_path / "j"), "r_regionkey int, r_name string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_bytes(b"\xef\xbb\xbfhi")
    assert files.walk(spark, str(tmp_path / "f"), "*.txt").count() == 1
    assert bytes(files.whole_files(spark, str(tmp_path / "f"), 100).select(files.without_bom(F.col("content")).alias("c")).first().c) == b"hi"
    assert files.whole_files(spark, str(tmp_path / "f"), 2, strict=False).count() == 0


def test_one_open_call_an_id(spark):
    """Against a plain loop over requests and replies: duplicates, timeouts, ties at one instant, ids kept alive."""
    asked = [("a", 0, 1), ("a", 5, 2), ("a", 9, 3), ("a", 9, 4), ("a", 19, 5), ("b", 0, 6), ("b", 4, 7), ("b", 5, 8), (None, 0, 9), (None, 3, 10)]
    told = [("a", 30), ("b", 4), ("c", 1), (None, 1)]
    q, r = spark.createDataFrame(asked, "id string, at long, tie int"), spark.createDataFrame(told, "id string, back long")

    def plain(keep):
        out, opened = {}, {}
        for at, kind, key, tie in sorted([(at, 0, str(k), t) for k, at, t in asked] + [(at, 1, str(k), 0) for k, at in told if k]):
            held = opened.get(key)
            if held and not keep and held[1] is None and at >= held[0] + 10:
                held = opened.pop(key, None) and None
            if kind == 0:
                out[tie] = "duplicate" if held else "timeout"
                if not held:
                    opened[key] = [at, None, tie]
            elif held and at < held[0] + 10 and out[held[2]] == "timeout":
                out[held[2]] = "answered"
                if not keep:
                    del opened[key]
        return out

    for keep in (False, True):
        got = stateful.tracked(q, r, "id", "at", "tie", "back", 10, keep).collect()
        assert {x.tie: x.outcome for x in got} == plain(keep)
        assert all((x.replied is not None) == (x.outcome == "answered") for x in got)
    assert stateful.tracked(q.limit(0), r, "id", "at", "tie", "back", 10).count() == 0


def test_adaptive_limit_falls_and_grows(spark):
    """Even times grow the limit to its most, a long queue shrinks it to 1; null and zero times change nothing."""
    rows = [("k", i, t) for i, t in enumerate([100] * 4 + [None, 0] + [100_000] * 60)]
    df = spark.createDataFrame(rows, "k string, at long, rtt long")
    got = [x.limit for x in stateful.adaptive_limit(df, ["k"], "at", "at", "rtt", 8, most=11).orderBy("at").collect()]
    assert got[:6] == [9.0, 10.0, 11.0, 11.0, 11.0, 11.0] and min(got) >= 1 and got[-1] < 11 and max(got) == 11


def test_adaptive_limit_forgets_the_least_time():
    """Once more than `forget` has gone by, an old least time no longer shrinks the limit; at exactly `forget` it does."""
    for now, limit in ((30, 10.0), (31, 12.0)):
        rule = rules.Adaptive(10, forget=30)
        _, state = rule.step(rule.first(), (0, 100))
        assert rule.step(state, (now, 1000))[0] == (limit,)
