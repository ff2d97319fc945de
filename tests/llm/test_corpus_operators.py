"""Near duplicates, secrets, mixing, language model, search and urls against brute force, and their edge cases."""

import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidewheel.llm")
from tidewheel.llm import apportion_mix, lattice_lm, near_dup, queries, rp_forest, secret_scan, url_trust  # noqa: E402
from tidewheel.llm._shared import remainder  # noqa: E402

EDGES = [(1, "one two three"), (2, ""), (3, None), (None, "one two three"), (5, "  \t\n"), (6, "one two three"), (6, "one two three"), (7, "x" * 4000)]


def edges(spark):
    return spark.createDataFrame(EDGES, "doc_id int, text string").withColumn("source", F.lit("s")).withColumn("node", F.lit("clash")).withColumn("size", F.lit(1))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    base = [r.choice(words) for _ in range(120)]
    texts = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = r.choice(words)
        texts.append(" ".join(w) if i % 3 else " ".join(r.choice(words) for _ in range(40)))
    texts += texts[:20]
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                x, y = root[i], root[j]
                root = [min(x, y) if z in (x, y) else z for z in root]
    out = near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), percent=85).collect()
    assert {x.doc_id: x.component_id for x in out} == dict(enumerate(root))
    assert all(x.n_shingles == len(sets[x.doc_id]) and x.kept == (root[x.doc_id] == x.doc_id) for x in out)


def test_near_duplicate_edges(spark):
    out = sorted((str(x.doc_id), x.n_shingles, x.component_id, x.kept) for x in near_dup.near_duplicates(edges(spark)).collect())
    assert out == sorted([("1", 1, 1, True), ("2", 0, 2, True), ("3", 0, 3, True), ("None", 1, 1, False), ("5", 0, 5, True), ("6", 1, 1, False), ("6", 1, 1, False), ("7", 1, 7, True)])
    assert near_dup.near_duplicates(edges(spark).limit(0)).count() == 0


def test_secret_spans_and_redaction(spark):
    r = random.Random(3)
    key = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    rows = [(1, f"é {key} é"), (2, 'PASSWORD = "abc"; token: abcdef1'), (3, "AKIA" + "A" * 15 + " AKIA" + "B" * 16), (4, "0" * 24 + " Donaudampfschifffahrtsgesellschaft abcdefghijklmnopqrstuvwxyz0123456789"), (5, None), (6, ""), (6, ""), (None, "token=token:abcdef")]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("base", F.lit("clash")).withColumn("cands", F.lit(1))
    found = secret_scan.scan(df, keep=("doc_id", "text"))
    spans = {x.doc_id: [tuple(s) for s in x.spans] for x in found.collect()}
    assert spans == {1: [(2, 42, "random")], 2: [(18, 32, "assign")], 3: [(20, 40, "access")], 4: [(0, 24, "hex")], 5: [], 6: [], None: []}
    texts = {x.doc_id: x.text for x in secret_scan.redact(found).collect()}
    assert texts[1] == "é [secret] é" and texts[2] == 'PASSWORD = "abc"; [secret]' and texts[5] is None
    assert secret_scan.scan(df.limit(0)).count() == 0


def test_secret_query_against_regular_expressions(spark, sf):
    docs = {x.doc_id: x.text for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    patterns = [re.compile(p, re.A) for p in (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"AKIA[A-Z0-9]+", r"[0-9a-f]+")]
    for x in queries.op6_secret_scan(spark, sf).collect():
        a = sum(len(m[1]) >= 6 for m in patterns[0].finditer(docs[x.doc_id]))
        assert (x.n_assign, x.n_access, x.n_hex) == (a, *(sum(len(m[0]) >= n for m in p.finditer(docs[x.doc_id])) for p, n in ((patterns[1], 20), (patterns[2], 24))))


def test_mix_equals_its_sql_and_stays_near_targets(spark, sf):
    got = sorted(map(tuple, queries.op7_apportion_mix(spark, sf).select("doc_id", "size", "source_size", "target", "taken").collect()))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got == sorted(c.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({apportion_mix.SQL})").fetchall())
    assert all(x[4] <= 2 * x[1] for x in got)


def test_seats_by_highest_quotients(spark):
    r = random.Random(8)
    votes = [r.randint(1, 5000) for _ in range(17)] + [0]
    for total in (0, 1, 40, 333):
        won = [0] * len(votes)
        for _ in range(total):
            won[max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))] += 1
        df = spark.createDataFrame([(0, i, v) for i, v in enumerate(votes)], "g int, i int, v bigint")
        got = apportion_mix.seats(df, ["g"], ["i"], "v", F.lit(total), "seats").orderBy("i").collect()
        assert [x.seats for x in got] == won


def test_mix_edges(spark):
    out = {(x.doc_id, x.size): x.taken for x in apportion_mix.mix(edges(spark).drop("size").withColumn("source", F.when(F.col("doc_id") > 5, F.lit(None)).otherwise("a")).withColumn("source", F.col("source").cast("string"))).collect()}
    assert out[2, 0] == out[3, 0] == out[5, 0] == 0 and all(v <= 2 * k[1] for k, v in out.items())
    assert apportion_mix.mix(edges(spark).limit(0)).count() == 0


def test_lattice_against_enumeration():
    pieces = lattice_lm.Pieces(["▁", "a", "b", "ab", "▁a", "ba"], np.log([0.2, 0.2, 0.1, 0.1, 0.2, 0.1]), np.full(256, math.log(0.1 / 256)))
    p = dict(zip(pieces.texts, np.exp(pieces.weights), strict=True))

    def whole(s):
        return 1.0 if not s else sum(p[s[:k]] * whole(s[k:]) for k in range(1, len(s) + 1) if s[:k] in p) + (whole(s[1:]) * (0.1 / 256) ** len(s[0].encode()) if s[0] not in p else 0)

    words = ["a", "abab", "bé", "", "aab"]
    assert np.allclose(lattice_lm.Lattice(pieces).run(words), [math.log(whole("▁" + w)) for w in words])


def test_language_model_edges(spark):
    df = edges(spark)
    out = lattice_lm.score(df, remainder("doc_id", 7) == 2, queries.rank_file("piece_bpe_32k.model")).collect()
    assert sorted(str(x.doc_id) for x in out) == sorted(str(i) for i, _ in EDGES)
    counts = {}
    train = [(i, t) for i, t in EDGES if __import__("zlib").crc32(b"" if i is None else str(i).encode()) % 7 != 2]
    for _, t in train:
        for w in [*(t or "").split(), None]:
            counts[w] = counts.get(w, 0) + 1
    n, v, ends = sum(counts.values()), len(counts), len(train)
    model, end = lattice_lm.Lattice(lattice_lm.read_pieces(queries.rank_file("piece_bpe_32k.model"))), (ends + 1) / (n + 2)
    log = dict(zip(counts, model.run([w or "" for w in counts]), strict=True))

    def left_out(share):
        return sum(c * np.logaddexp(math.log(share * (c - 1) / (n - ends - 1)) if c > 1 else -np.inf, math.log(1 - share) + log[w]) for w, c in counts.items() if w is not None)

    share = max(lattice_lm.SHARES, key=left_out)
    for x in out:
        words = [*(dict(EDGES)[x.doc_id] or "").split(), None]
        assert x.train_tokens == n and x.n_tokens == len(words) and x.score < 0
        spelt = dict(zip(words, np.exp(model.run([w or "" for w in words])), strict=True))
        own = [math.log10(1 - end) + math.log10(share * counts.get(w, 0) / (n - ends) + (1 - share) * max(spelt[w], 1e-300)) for w in words[:-1] if spelt[w] > 0]
        if len(own) == len(words) - 1:
            assert math.isclose(x.score, sum(own) + math.log10(end), rel_tol=1e-9)
        assert math.isclose(x.base_score, sum(math.log10((counts.get(w, 0) + 1) / (n + 1 * (v + 1))) for w in words))
    assert lattice_lm.score(df.limit(0), F.lit(False), queries.rank_file("piece_bpe_32k.model")).count() == 0


def test_search_against_brute_force(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(700, 16)).round(3)
    x[100:300] = x[7]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (920, [0.0] * 16), (940, [float("nan")] * 16), (960, [1.0, None] * 8), (980, [1.0] * 3), (None, x[1].tolist()), (20, x[20].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("clash"))
    out = rp_forest.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()
    hit = 0
    for q in range(0, 700, 20):
        mine = sorted((y for y in out if y.query_id == q), key=lambda y: y.rank)
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        order = np.lexsort((np.arange(700), -s))[:20]
        hit += len({y.vec_id for y in mine} & set(order.tolist()))
        assert [y.rank for y in mine] == list(range(1, 21))
        assert mine == sorted(mine, key=lambda y: (-y.score, y.vec_id))
        assert all(math.isclose(y.score, s[y.vec_id], rel_tol=1e-12) for y in mine)
    assert hit / 700 >= 0.9
    assert {y.query_id for y in out} == set(range(0, 700, 20))
    assert rp_forest.nearest(df.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_url_verdicts(spark):
    def page(i, url, *links):
        return (i, url, "".join(f'<a href="{x}">x</a>' for x in links))

    rows = [
        page(1, "https://a.good.com/x", "https://b.org/1"),
        page(2, "http://bad.net/fr/x"),
        page(3, "http://spam.org/", "http://bad.net/fr/", "http://bad.net/es/"),
        page(4, "http://b.org/y", "http://a.good.com/"),
        page(5, None),
        page(6, "mailto:x"),
        page(7, "HTTP://WWW.Example.com/en/q?x#y"),
        page(8, "http://m.example.com/en/q"),
        (8, "http://m.example.com/en/q", None),
    ]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").withColumn("trust", F.lit("clash"))
    out = {x.page_id: x for x in url_trust.judge(df, queries.URL_RULES).collect()}
    assert {i: x.verdict for i, x in out.items()} == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "block"}
    assert (out[7].host, out[7].path, out[7].rule) == ("www.example.com", "/en/q", "www.example.com/en/") and out[5].host == out[6].path == ""
    assert math.isclose(out[3].distrust, 0.85, abs_tol=1e-3)
    assert url_trust.judge(df.limit(0), queries.URL_RULES).count() == 0


def test_propagation_against_a_solver(spark):
    r = np.random.default_rng(2)
    n = 12
    w = r.integers(0, 4, (n, n)) * (1 - np.eye(n, dtype=int))
    seed = r.random((n, 2)).round(2)
    links = spark.createDataFrame([(f"h{i}", f"h{j}", int(w[i, j])) for i in range(n) for j in range(n) if w[i, j]], "from string, to string, pages bigint")
    seeds = spark.createDataFrame([(f"h{i}", float(seed[i, 0]), float(seed[i, 1])) for i in range(n)], "host string, trusted double, blocked double")
    got = {x.host: x for x in url_trust.propagate(seeds, links).collect()}
    for k, (name, m) in enumerate((("trust", w), ("distrust", w.T))):
        share = m / np.maximum(m.sum(1, keepdims=True), 1)
        want = np.linalg.solve(np.eye(n) - 0.85 * share.T, seed[:, k])
        assert np.allclose([got[f"h{i}"][name] for i in range(n)], want, rtol=0.02)


def test_trust_flows_between_a_domain_and_its_hosts(spark):
    hosts = [("a.b.x.net", 3), ("c.x.net", 2), ("x.net", 1), ("10.0.0.1", 5), ("y.org", 1), ("", 1)]
    got = {tuple(x) for x in url_trust.family_edges(spark.createDataFrame(hosts, "host string, n bigint")).collect()}
    want = {("a.b.x.net", "b.x.net", 3), ("b.x.net", "x.net", 3), ("c.x.net", "x.net", 2)}
    assert got == want | {(b, a, n) for a, b, n in want}
    rows = [(i, f"http://{h}/{p}/") for i, (h, p) in enumerate([("s.bad.net", "es"), ("s.bad.net", "fr"), ("t.bad.net", "x"), ("u.bad.net", "x"), ("t.other.net", "x")])]
    out = {x.page_id: x for x in url_trust.judge(spark.createDataFrame(rows, "page_id int, url string").withColumn("html", F.lit(None).cast("string")).withColumn("rule", F.lit("clash")), queries.URL_RULES, keep=("page_id", "rule")).collect()}
    m = np.zeros((4, 4))  # s, t, u, domain
    m[:3, 3], m[3, :3] = 1, (0.5, 0.25, 0.25)
    want = np.linalg.solve(np.eye(4) - 0.85 * m.T, [1, 0, 0, 0])
    assert np.allclose([out[i].distrust for i in (0, 2, 3)], want[:3], rtol=5e-3)
    assert [out[i].verdict for i in range(5)] == ["block", "block", *["block" if x >= 0.5 else "allow" for x in want[1:3]], "allow"]


def test_search_visits_few_rows_of_clustered_vectors(spark):
    """20,000 vectors in clusters: over nine tenths of the neighbours from under three tenths of the rows."""
    r = np.random.default_rng(1)
    x = np.repeat(r.normal(size=(400, 32)), 50, 0) + 0.4 * r.normal(size=(20_000, 32))
    df = spark.createDataFrame(__import__("pandas").DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}))
    out = rp_forest.nearest(df, F.col("vec_id") % 500 == 0, 20).toPandas()
    asked = np.arange(0, len(x), 500)
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    want = np.argsort(-s, axis=1)[:, :20]
    assert np.mean([len(set(w) & set(out[out.query_id == q].vec_id)) / 20 for q, w in zip(asked, want, strict=True)]) >= 0.9

    forest = rp_forest.grow(x, len(x) // rp_forest.LEAF, rp_forest.TREES, float(np.linalg.norm(x, axis=1).max()))
    leaves = forest.leaves_of(x)
    places = np.concatenate([forest.places_of(x[q], leaves[w]) for q, w in zip(asked, want, strict=True)])
    probes = int(np.quantile(places, rp_forest.RECALL, method="higher"))
    visited = [np.isin(leaves, own).any(1) for own in forest.probes_of(x[asked], probes)]
    assert np.mean(visited) <= 0.3
    held = np.mean([v[w].mean() for v, w in zip(visited, want, strict=True)])
    assert held >= rp_forest.RECALL - 0.01  # the places are those at which the queue comes to the leaves


def test_secret_joined_to_a_base_span_is_found(spark):
    r = random.Random(11)
    secrets = ["".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40)) for _ in range(20)]
    key = "AKIA" + "Z7Q2" * 4
    df = spark.createDataFrame([(i, f"see {key}/{s} here") for i, s in enumerate(secrets)], "doc_id int, text string")
    found = secret_scan.scan(df, keep=("doc_id", "text"))
    spans = {x.doc_id: [(y.start, y.end, y.kind) for y in x.spans] for x in found.collect()}
    hits = sum((24, 65, "random") in v for v in spans.values())
    assert hits >= 15 and all((4, 24, "access") in v for v in spans.values())
    texts = secret_scan.redact(found).collect()
    assert sum(x.text == "see [secret][secret] here" for x in texts) == hits
