"""Every operator and every pipeline stage on nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidewheel.llm")
import corpus_pipeline  # noqa: E402

from tidewheel.llm import apportion_mix, byte_bpe, lattice_lm, near_dup, png_media, quality_rules, queries, secret_scan, toxicity, url_trust  # noqa: E402

R = random.Random(4)
WORDS = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(2, 9))) for _ in range(3000)]
LONG = " ".join(R.choice(WORDS) for _ in range(800_000))
KEY = "A9fK2lQ7xZ0pW3sV8bN1mC6yT5rE4uHjGdKq2Z7x"
ROWS = [
    (1, "one two three four five six seven"), (2, ""), (3, None), (None, "no id at all, but some words in a row"), (5, " \t\n"), (6, f"key {KEY} end"), (6, f"key {KEY} end"), (6, "another text under the same id, quite alone"),
    (7, "one two three four five six seven"), (8, LONG), (9, LONG), (None, None), (10, "\u0000 \ud7ff \U0001f600 é"),
]
CLASHES = ("stat", "quality", "toxicity", "hex", "assign", "access", "cands", "base", "spans", "copies", "copy", "row", "key", "node", "bucket", "part", "size", "taken", "place", "target", "name", "ids", "ends", "word", "kept", "label", "text__", "kept__")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string").withColumn("lang", F.lit("xx")).withColumn("source", F.when(F.col("doc_id") % 2 == 0, "a")).withColumn("n_chars", F.length("text").cast("long"))
    df = df.select("*", *[F.lit("clash").alias(c) for c in CLASHES])
    return corpus_pipeline.written(df.repartition(3))


def ids(df):
    return sorted(str(x.doc_id) for x in df.select("doc_id").collect())


EVERY = sorted(str(i) for i, _ in ROWS)


def test_scores_of_odd_rows(docs, spark):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (7, 1, 0), (8, 1, 0)], "doc_id bigint, quality int, toxic int")
    for model, score, name in ((quality_rules.fit(docs, labels, F.lit(False)), quality_rules.score, "quality"), (toxicity.fit(docs, labels, F.lit(False)), lambda d, m: toxicity.score(d, m, keep=tuple(docs.columns)), "toxicity")):
        out = score(docs, model)
        assert ids(out) == EVERY and out.where(f"{name} between 0 and 1").count() == len(ROWS)
        assert len({c.lower() for c in out.columns}) == len(out.columns)
        assert score(docs.limit(0), model).count() == 0


def test_tokens_of_odd_rows(docs):
    out = byte_bpe.encode(docs, queries.rank_file(), keep=("doc_id",), decoded=True).select("doc_id", "n_tokens", F.sha2("decoded", 256).alias("h")).collect()
    want = sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS)
    assert sorted((str(x.doc_id), x.h) for x in out) == want
    assert byte_bpe.encode(docs.limit(0), queries.rank_file()).count() == 0


def test_media_of_odd_rows(docs):
    back = png_media.load(png_media.store(docs), keep=("doc_id",), payload=True).select("doc_id", F.sha2("payload", 256).alias("h")).collect()
    padded = [(i, (t or "").encode()) for i, t in ROWS]
    want = sorted((str(i), hashlib.sha256(b.ljust(max(1, -(-len(b) // 64)) * 64, b"\0")).hexdigest()) for i, b in padded)
    assert sorted((str(x.doc_id), x.h) for x in back) == want
    assert png_media.store(docs.limit(0)).count() == 0


def test_groups_of_odd_rows(docs):
    out = near_dup.near_duplicates(docs)
    assert ids(out) == EVERY
    group = {(x.doc_id, x.n_shingles): (x.component_id, x.kept) for x in out.collect()}
    assert group[7, 3] == (1, False) and group[1, 3] == (1, True) and group[2, 0] == (2, True)
    assert {c for (i, n), (c, _) in group.items() if n > 100_000} == {8}


def test_secrets_of_odd_rows(docs):
    out = secret_scan.scan(docs, keep=tuple(docs.columns))
    assert ids(out) == EVERY and len({c.lower() for c in out.columns}) == len(out.columns)
    assert out.where("doc_id = 8").select(F.size("base")).first()[0] == 0


def test_mix_of_odd_rows(docs):
    out = apportion_mix.mix(docs)
    assert ids(out) == EVERY and out.where("taken > 2 * size or taken < 0").count() == 0


def test_language_model_of_odd_rows(docs):
    out = lattice_lm.score(docs, F.lit(False), queries.rank_file("piece_bpe_32k.model"))
    assert ids(out) == EVERY and out.where("score < 0 and base_score < 0").count() == len(ROWS)
    n = {(x.doc_id, x.n_tokens) for x in out.collect()}
    assert (2, 1) in n and (3, 1) in n and (8, 800_001) in n


def test_urls_of_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (2, "", ""), (None, "http://a.net/es/", "<a href=//b.org>"), (3, "http://x" + "/y" * 1_000_000, None), (4, "http://", None), (5, "a://H.Com:80?x", None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").select("*", *[F.lit("clash").alias(c) for c in ("host", "path", "rule", "verdict", "trust", "ruling__", "n")])
    out = url_trust.judge(df, queries.URL_RULES, keep=("page_id", "host", "n"))
    assert {(x.page_id, x.host): x.verdict for x in out.collect()} == {(1, ""): "allow", (2, ""): "allow", (None, "a.net"): "block", (3, "x"): "allow", (4, ""): "allow", (5, "h.com:80"): "allow"}
    assert out.count() == len(rows) and url_trust.judge(df.limit(0), queries.URL_RULES).count() == 0


@pytest.mark.parametrize("number", range(5))
def test_stage_on_odd_rows(docs, spark, sf, number):
    name, stage = corpus_pipeline.STAGES[number]
    out = stage(spark, docs, sf)
    if number < 4:
        assert out.columns == docs.columns
    assert stage(spark, docs.limit(0), sf).count() == 0
    got = sorted(((str(x[0]), x[1]) for x in out.select("doc_id", "text" if number < 4 else "source").collect()), key=str)
    if name in ("toxicity", "byte-level BPE"):
        assert [x[0] for x in got] == EVERY
    if name == "near duplicates":  # 7 and 9 are copies, one of two equal rows of 6 goes, its other text stays
        want = [(i, t) for k, (i, t) in enumerate(ROWS) if i not in (7, 9) and k != 6]
        assert got == sorted(((str(i), t) for i, t in want), key=str)
    if name == "secrets":
        assert [x[0] for x in got] == EVERY
        assert out.where("n_chars != coalesce(length(text), 0)").count() == 0
    if name == "mixing":
        assert {x[0] for x in got} <= set(EVERY) and ("2", "") not in got


def folded(text):
    return f" {re.sub(r'\s+', ' ', text.lower()).strip()} "


def test_ngrams_against_slices():
    texts = ["Ab  c\u00e9\n\nd", "", "x", "\U0001f600abcdef" * 3, "ab"]
    own, found = toxicity.grams([t.encode() for t in texts])
    for i, t in enumerate(texts):
        f = folded(t)
        want = [f[k : k + n] for n in toxicity.ORDERS for k in range(len(f) - n + 1)]
        got = found[own == i]
        assert len(got) == len(want)
        assert len(set(got.tolist())) == len(set(want))
    same, again = toxicity.grams([texts[0].encode()]), toxicity.grams([b"zz", texts[0].encode()])
    assert sorted(same[1]) == sorted(again[1][again[0] == 1])


def test_counts_against_sets():
    import pyarrow as pa

    texts, labels = ["good day", "good night", "bad day", "bad bad night"], [0, 0, 1, 1]
    out = next(toxicity.counts(iter([pa.RecordBatch.from_arrays([pa.array(labels), pa.array(texts)], names=["label", "text"])])))
    by = {b: (t, c) for b, t, c in zip(*(x.to_pylist() for x in out.columns), strict=True)}
    sets = [set(toxicity.grams([t.encode()])[1].tolist()) for t in texts]
    assert by == {b: (sum(b in s for s, y in zip(sets, labels, strict=True) if y), sum(b in s for s, y in zip(sets, labels, strict=True) if not y)) for b in set().union(*sets)}


def test_statistics_against_a_plain_count(spark):
    texts = ["One two. Two two!\n\nA|B 12 $%", "", "   ", "éé É\ttab", "x" * 50, "a. b. a. b.\na\na"]
    out = quality_rules.statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    for x, t in zip(out, texts, strict=True):
        words, lines, sentences = ([p for p in re.split(s, t) if p] for s in (r"[ \t-\r]+", "\n", r"[.!?\n] *"))

        def count(chars, t=t):
            return sum(c in chars for c in t)

        def share(a, b):
            return a / b if b else 0.0

        n = len(t)
        want = {
            "chars": n, "words": len(words), "word_length": share(n, len(words)), "upper": share(count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), n), "digits": share(count("0123456789"), n),
            "symbols": share(count("#$%&*@^~<>{}[]\\=_+"), n), "bars": share(count("|"), n), "shouts": share(count("!?"), n), "stops": share(count(".,;:"), n), "spaces": share(count(" \t\n"), n),
            "distinct_words": share(len(set(words)), len(words)), "lines": share(len(lines), len(words)), "distinct_lines": share(len(set(lines)), len(lines)), "sentences": share(len(sentences), len(words)),
            "distinct_sentences": share(len(set(sentences)), len(sentences)), "wide": share(len(t.encode()), n),
        }
        assert {k: round(v, 9) for k, v in x.stat.asDict().items()} == {k: round(float(v), 9) for k, v in want.items()}


def test_lasso_meets_its_conditions():
    r = np.random.default_rng(7)
    m = (r.random((300, 12)) < 0.4).astype(float)
    y = (r.random(300) < 1 / (1 + np.exp(-(m[:, 0] * 3 - m[:, 1] * 2)))).astype(float)
    penalty = 0.02
    b, w = quality_rules.lasso(m, y, penalty, (0.0, np.zeros(12)), 4000)
    e = 1 / (1 + np.exp(-(m @ w + b))) - y
    g = m.T @ e / 300
    assert abs(e.mean()) < 1e-4 and (np.abs(g[w == 0]) <= penalty + 1e-4).all()
    assert np.allclose(g[w != 0], -penalty * np.sign(w[w != 0]), atol=1e-4) and (w == 0).any()


def test_hash_against_a_plain_transform():
    r = np.random.default_rng(3)
    for height in (1, 7, 32, 100):
        x = r.integers(0, 256, (height, 64))
        rows = [[sum(x[min(int(p), height - 1), c] * w for p, w in over(i * height / 32, (i + 1) * height / 32)) for c in range(64)] for i in range(32)]
        grid = np.array([[sum(row[2 * j : 2 * j + 2]) / 2 for j in range(32)] for row in rows])
        low = np.array([[sum(grid[a, b] * math.cos(math.pi * u * (2 * a + 1) / 64) * math.cos(math.pi * v * (2 * b + 1) / 64) for a in range(32) for b in range(32)) for v in range(8)] for u in range(8)]).ravel()
        got = np.unpackbits(np.frombuffer(bytes.fromhex(png_media.low_frequency_hash(x.astype(np.uint8).reshape(height, 64, 1))), np.uint8))
        sure = np.abs(low - np.median(low)) > 0.5
        assert (got[sure] == (low > np.median(low))[sure]).all() and sure.sum() >= 8


def over(a, b):
    """Whole samples from a to b and the share of each."""
    k = math.floor(a)
    while k < b - 1e-12:
        yield k, (min(b, k + 1) - max(a, k)) / (b - a)
        k += 1


def test_base_spans_and_their_digest(spark, sf):
    docs = {x.doc_id: x.text for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    kinds = [("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1), ("access", "AKIA[A-Z0-9]+", 20, 0), ("hex", "[0-9a-f]+", 24, 0)]
    for x in queries.op6_secret_scan(spark, sf).collect():
        spans = sorted((m.start(), i, m.end(), name) for i, (name, p, least, g) in enumerate(kinds) for m in re.finditer(p, docs[x.doc_id] or "") if len(m[g]) >= least)
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert x.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        found = [s.split(":") for s in x.spans.split(",") if s]
        assert [f"{k}:{a}:{b}" for k, a, b in found if k != "random"] == [s for s in text.split(",") if s]
        assert all(int(b) - int(a) >= secret_scan.LEAST and re.fullmatch("[A-Za-z0-9+/_-]+", docs[x.doc_id][int(a) : int(b)]) for k, a, b in found if k == "random")


def test_battery_against_numpy(spark):
    tokens = ["".join(R.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n)) for n in (20, 33, 64)] + ["Ab" * 15, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    df = secret_scan.located(spark.createDataFrame(list(enumerate(tokens)), "doc_id int, text__ string"), "text__", "cands", secret_scan.CANDIDATE)
    for name, value in secret_scan.STEPS:
        df = df.withColumn("cands", F.transform("cands", secret_scan.with_field(name, value)))
    for x in df.orderBy("doc_id").collect():
        c, t = x.cands[0], tokens[x.doc_id]
        marks = np.array([c.alphabet.index(ch) + 1 for ch in t], float)
        n, k = len(t), len(c.alphabet)
        counts = np.array([t.count(ch) for ch in c.alphabet], float)
        chi = (counts - n / k) ** 2 / (n / k)
        assert math.isclose(c.chi, (chi.sum() - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n), rel_tol=1e-9)
        high = marks > k / 2
        assert c.runs == 1 + (high[1:] != high[:-1]).sum()
        d = marks - marks.mean()
        assert math.isclose(c.serial_z, ((d[1:] * d[:-1]).sum() / (d * d).sum() + 1 / n) * math.sqrt(n), rel_tol=1e-9)
        assert math.isclose(c.repeats_z, (secret_scan.NATURAL_REPEAT * n * (n - 1) / 2 - (counts * (counts - 1) / 2).sum() - 0.5) / math.sqrt(secret_scan.NATURAL_REPEAT * (1 - secret_scan.NATURAL_REPEAT) * n * (n - 1) / 2), rel_tol=1e-9)


