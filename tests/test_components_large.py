"""Connected components: the order of whole nodes, and nodes of every type with loose ends."""

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import components
from tidewheel.plans import catalog


def test_order_of_whole_nodes_is_a_permutation(spark):
    numbers = [0, 1, -1, 5, 1 << 31, 1 << 32, (1 << 63) - 1, -(1 << 63), -(1 << 40) - 7]
    df = spark.createDataFrame([(x,) for x in numbers], "x bigint").select("x", components._shuffled(F.col("x"), 3).alias("y"), components._shuffled(F.col("x"), 4).alias("z"))
    got = df.select("x", "y", "z", components._shuffled(F.col("y"), 3, back=True).alias("back")).collect()
    assert all(g.back == g.x for g in got) and len({g.y for g in got}) == len(numbers) and all(g.y != g.z for g in got)


@pytest.mark.parametrize("kind", ["int", "bigint", "string"])
def test_loose_ends_and_chains(spark, kind):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, 7), (None, 8), (9, None), (None, None), (1, 2), (2, 1), (1, 2)]
    df = spark.createDataFrame(links, "a int, b int").select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"))
    out = components.labelled(df)
    assert out.schema["node"].dataType.simpleString() == kind
    want = {**{i: (100, 61) for i in range(100, 161)}, 1: (1, 2), 2: (1, 2), 7: (7, 1), 8: (8, 1), 9: (9, 1)}
    assert {int(x.node): (int(x.component), x["size"]) for x in out.collect()} == want


@pytest.mark.parametrize("far", [3, (1 << 62) - 1, 1 << 62, -5])
def test_bipartite_keys_of_any_size(spark, tmp_path, far):
    rows = [(far, 1), (2, 1), (2, far), (4, None), (None, 6)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint").write.parquet(str(tmp_path / "lineitem.parquet"))
    own = [f"o{far}", "o2", "p1", f"p{far}"]
    got = {x.node: (x.component, x["size"]) for x in catalog.QUERIES["components_bipartite"](spark, str(tmp_path)).collect()}
    assert got == {**{n: (min(own), 4) for n in own}, "o4": ("o4", 1), "p6": ("p6", 1)}
