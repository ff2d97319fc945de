"""Queries that once ran on a part of their table: each must cover all of it."""

import random
from collections import Counter
from datetime import datetime, timedelta
from urllib.parse import quote

from tidewheel.plans import catalog


def test_time_range_expands_every_order(spark, sf):
    days = {x.o_orderkey: x.o_orderdate for x in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderdate").collect()}
    want = sorted((k, datetime(d.year, d.month, d.day) + timedelta(hours=12 * i)) for k, d in days.items() for i in range(5))
    assert sorted((x.o_orderkey, x.at) for x in catalog.QUERIES["time_range"](spark, sf).collect()) == want


def test_url_escape_covers_whole_texts(spark, sf):
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {x.doc_id: (x.escaped, x.back) for x in catalog.QUERIES["url_escape"](spark, sf).collect()}
    assert got == {k: (quote(t, safe=""), t) for k, t in texts.items()}


def test_ascii_fold_covers_whole_texts(spark, sf):
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = {x.doc_id: (x.low, x.has) for x in catalog.QUERIES["ascii_fold"](spark, sf).collect()}
    assert got == {k: (t.translate(fold), "license" in t.translate(fold)) for k, t in texts.items()}


def test_html_escape_covers_whole_pages(spark, sf):
    pages = {x.page_id: x.html for x in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()}
    marks = {ord(c): f"\\u{ord(c):04x}" for c in "<>&\u2028\u2029"}
    got = {x.page_id: x.v for x in catalog.QUERIES["html_escape"](spark, sf).collect()}
    assert got == {k: h.translate(marks) for k, h in pages.items()}


def test_components_bipartite_links_every_row(spark, tmp_path):
    r = random.Random(3)
    links = [(r.randrange(60), r.randrange(90), float(r.randrange(1, 51))) for _ in range(70)]
    spark.createDataFrame(links, "l_orderkey bigint, l_partkey bigint, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for o, p, _ in links:
        a, b = find(f"o{o}"), find(f"p{p}")
        parent[max(a, b)] = min(a, b)
    roots = {x: find(x) for x in parent}
    sizes = Counter(roots.values())
    got = {x.node: (x.component, x["size"]) for x in catalog.QUERIES["components_bipartite"](spark, str(tmp_path)).collect()}
    assert got == {x: (c, sizes[c]) for x, c in roots.items()}


def test_longest_prefix_has_keys_of_every_part(spark, tmp_path):
    parts = [(1, "red"), (2, "blue sky deep"), (3, "red wine"), (4, "blue sky deep water"), (50, "red win"), (7, "pink x"), (8, "redder")]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    keys = {n for _, n in parts} | {n.split(" ")[0] for _, n in parts}
    got = {x.p_partkey: x.found for x in catalog.QUERIES["longest_prefix"](spark, str(tmp_path)).collect()}
    assert got == {k: max((key for key in keys if n.startswith(key)), key=len) for k, n in parts}
