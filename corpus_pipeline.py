"""A corpus pipeline in five stages, each over all that its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, and all but the last
keep the columns of documents. run() applies them to the documents table with a written table between stages.

Decisions about rows are found by a key of the id and a hash of all columns, so rows that share an id, or have none,
are judged by their own text; rows that are equal in all columns count as one document from the second stage on. Null
and empty texts are never toxic by themselves, near no other text and without secrets; having no words, they aren't
taken by the mix. Further columns may have any name. Empty tables give empty tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import apportion_mix, byte_bpe, near_dup, secret_scan, toxicity
from tidewheel.llm._shared import small, written
from tidewheel.llm.queries import rank_file
from tidewheel.sources.tables import table

#: Toxicity from which a document is rejected; similarity in per cent from which documents are near duplicates.
TOXIC, SIMILAR = 0.7, 80


def row_key(docs: DataFrame) -> Column:
    """Whether the id is null, the id, and a hash of all columns: in this order, so that the smallest id comes first."""
    hashed = [f"`{f.name}`" for f in docs.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(*hashed).alias("rest"))


def packed(docs: DataFrame) -> DataFrame:
    """row (all columns in one), doc_id, text, source and the row's key, so that no column meets a name in use."""
    return docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), row_key(docs).alias("key"), "doc_id", "text", "source")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, learnt from all labels of documents at hand, finds toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(False))
    return toxicity.score(packed(docs), model, keep=("row",)).where(F.col("toxicity") < TOXIC).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id, of several texts under that id the first by hash; of equal rows one."""
    rows = packed(docs)
    found = near_dup.near_duplicates(rows.select("key", "text"), percent=SIMILAR, key="key")
    found = written(found.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")))
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("key"))
    out = rows.join(small(gone), "key", "left_anti")
    repeated = found.where("kept and n > 1").select(F.col("doc_id").alias("key"))
    if not repeated.isEmpty():
        repeated = small(repeated)
        once = out.join(repeated, "key", "left_semi").groupBy("key").agg(F.first("row").alias("row"))
        out = out.join(repeated, "key", "left_anti").select("key", "row").unionByName(once)
    return out.select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark and n_chars, if there is such a column, counted anew."""
    found = secret_scan.redact(secret_scan.scan(packed(docs), keep=("row", "text")))
    new = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text").cast("long"), F.lit(0))}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: the words taken over its size, to the nearest whole number."""
    rows = packed(docs)
    taken = apportion_mix.mix(rows.select(F.col("key").alias("doc_id"), "source", "text")).where("taken > 0")
    copies = written(taken.groupBy("doc_id").agg(F.floor(F.sum("taken") / F.sum("size") + 0.5).cast("int").alias("copies")).where("copies > 0").withColumnRenamed("doc_id", "key"))
    return rows.join(small(copies), "key").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, and digests of the ids and of the bytes they decode to."""
    ids = byte_bpe.encode(docs, rank_file(), keep=("doc_id", "source"), decoded=True)
    return ids.select("doc_id", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("byte-level BPE", encode_tokens),
]

#: The classifier, the components and the tokenizer have no form in SQL; tests compare each stage with a plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
