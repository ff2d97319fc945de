"""The thin queries over the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import apportion_mix, byte_bpe, lattice_lm, near_dup, png_media, quality_rules, rp_forest, secret_scan, toxicity, url_trust
from tidewheel.llm._shared import remainder
from tidewheel.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rank_file(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document by rules learnt from four fifths of the labels."""
    docs, held_out = table(spark, sf_dir, "documents"), remainder("doc_id", 5) == 0
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"), held_out)
    scored = quality_rules.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.3).cast("int").alias("predicted"))


#: Rules of the url query: host and path, verdict.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


@query
def op2_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url: by the longest rule, else by what flows over links between hosts."""
    return url_trust.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    """Encode and decode every document; digests of the ids and of the decoded bytes."""
    ids = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks or rank_file(), decoded=True)
    return ids.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked at a similarity of 0.85 on 5-word shingles."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query
def op5_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every document as a PNG, read it back and hash its low frequencies."""
    stored = png_media.store(table(spark, sf_dir, "documents"))
    back = png_media.load(stored, keep=("doc_id", "n_bytes", "media"), payload=True)
    return back.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, length(payload) - 63, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "width",
        "height",
    )


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and a digest of the fixed patterns' spans, and all spans."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{kind}')) as bigint) as n_{kind}") for kind in secret_scan.BASE]
    return found.select("doc_id", *counts, F.sha2(secret_scan.written_spans(F.col("base")), 256).alias("base_sha256"), secret_scan.written_spans(F.col("spans")).alias("spans"))


@query
def op7_apportion_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix of all sources takes of every document."""
    return apportion_mix.mix(table(spark, sf_dir, "documents"))


ORACLE["op7_apportion_mix"] = apportion_mix.SQL


@query
def op8_lattice_lm(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """The log10 probability of every document, learnt from six sevenths of them."""
    return lattice_lm.score(table(spark, sf_dir, "documents"), remainder("doc_id", 7) == 2, model or rank_file("piece_bpe_32k.model"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learnt from two thirds of the labels."""
    docs, held_out = table(spark, sf_dir, "documents"), remainder("doc_id", 3) == 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), held_out)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))


@query
def op10_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows by inner product for every row whose id is divisible by 20."""
    return rp_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
