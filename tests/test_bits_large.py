"""Bit sets of many values: right for any whole value, without a sort of the rows."""

import random

from tidewheel.operators import bits


def test_cardinality_of_sparse_and_dense_sets(spark):
    r = random.Random(4)
    rows = [(r.randrange(5), r.choice([r.randrange(700), r.randrange(-(1 << 62), 1 << 62), 511, 512, -1, None])) for _ in range(3000)] + [(9, None), (10, 64), (10, 64)]
    df = spark.createDataFrame(rows, "k int, v bigint")
    got = {x.k: x.n for x in bits.cardinality(bits.bitmap(df, ["k"], "v"), ["k"]).collect()}
    assert got == {k: len({v for j, v in rows if j == k and v is not None}) for k, _ in rows}


def test_bitmaps_are_small_and_need_no_sort(spark):
    made = bits.bitmap(spark.range(1000).selectExpr("id % 7 AS k", "id * 40000 AS v"), ["k"], "v")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Sort [" not in plan
    assert made.selectExpr("max(length(cast(to_json(struct(bitmap)) as binary))) AS n").first().n < 400
