"""What near duplicates move between tasks, and the ways taken by hot buckets and by many wanted ids."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidewheel.llm")
from tidewheel.llm import _shared, near_dup  # noqa: E402
from tidewheel.sources.shared import written  # noqa: E402


def texts(n, length=200, seed=1):
    """Unrelated texts, and for each a copy whose changed words leave about 0.7 of its shingles, so that buckets stay open."""
    r = random.Random(seed)
    words = [f"word{i}" for i in range(20_000)]
    out = []
    for _ in range(n // 2):
        w = [r.choice(words) for _ in range(length)]
        out.append(" ".join(w))
        for i in range(0, length, length // 8):
            w[i] = r.choice(words)
        out.append(" ".join(w))
    return out


def shuffled_bytes(spark):
    """Bytes that all tasks so far wrote for shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    found = sc.statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_shuffle_stays_near_the_input(spark):
    docs = written(spark.createDataFrame(list(enumerate(texts(3000))), "doc_id long, text string"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables beyond it
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled_bytes(spark)
        near_dup.near_duplicates(docs, percent=85).write.format("noop").mode("overwrite").save()
        moved = shuffled_bytes(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert moved < 7 * size, moved / size


def components_by_all_pairs(docs, percent):
    sets, root = [], list(range(len(docs)))
    for t in docs:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((root[i], root[j]))
                root = [x if z == y else z for z in root]
    return root


@pytest.mark.parametrize("hot, sent", [(500, 32_000_000), (2, 200)])
def test_hot_buckets_and_several_passes(spark, monkeypatch, hot, sent):
    r = random.Random(5)
    base, docs = [f"b{i}" for i in range(100)], []
    for i in range(60):  # a chain: each differs a little from the one before
        base[r.randrange(100)] = f"c{i}"
        docs.append(" ".join(base))
    docs += texts(40, 60, 2)
    monkeypatch.setattr(near_dup, "SCOUTS", 1 if hot == 2 else near_dup.SCOUTS)
    monkeypatch.setattr(near_dup, "BROADCAST_BYTES", sent)
    for module in (near_dup, _shared):
        monkeypatch.setattr(module, "HOT", hot)
    out = near_dup.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string"), percent=85).collect()
    assert {x.doc_id: x.component_id for x in out} == dict(enumerate(components_by_all_pairs(docs, 85)))


def test_buckets_are_counted_with_hot_ones_dealt(spark, monkeypatch):
    for module in (near_dup, _shared):
        monkeypatch.setattr(module, "HOT", 50)
    rows = [(i, b) for i in range(3000) for b in (i % 2 or i, 10_000 + i // 3)]  # bucket 1 has half of all numbers
    met, hot = near_dup.shared_buckets(spark.createDataFrame(rows, "number long, bucket long"))
    assert {x.bucket for x in hot.collect()} == {1}
    got = {(x.number, x.bucket): x.met for x in met.collect()}
    assert set(got) == {(n, b) for n, b in rows if b == 1 or b >= 10_000} and len(got) == met.count()
    assert all(v == 3 for (_, b), v in got.items() if b != 1) and all(750 < v < 3000 for (_, b), v in got.items() if b == 1)


def test_sets_of_repeated_and_null_ids_come_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c d"), (None, "e f"), (None, "e f"), (2, "a b"), (3, "g h"), (4, "unwanted")], "doc_id int, text string")
    wanted = written(spark.createDataFrame([(1,), (2,), (3,)], "doc_id int"))
    for sent in (32_000_000, 16):
        monkeypatch.setattr(near_dup, "BROADCAST_BYTES", sent)
        assert near_dup.sets_of(docs, 5, wanted, "text", "doc_id").count() == 4
