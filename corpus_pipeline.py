"""Training-corpus pipeline: toxicity, near duplicates, repeats, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes
its result as Parquet to the shared folder, hands what it reads back to the
next stage and deletes what that one has read.  All but the last return the
columns of documents.  A stage lowers the bytes of the session's Arrow batches,
unless they are set (`small_batches`), as its result is computed after it
returns; `run`, which writes all results itself, sets them back.

Defined cases for all stages: null and empty texts are kept as they are (they
are not toxic, link with nothing, hold no repeats and no secrets, and pack as
the closing id); very long texts are taken whole; an empty table gives no rows;
extra columns pass through all stages but the last.  Repeated rows of one id:
the second stage keeps one of them.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import ngram_join, packing, secret_scan, suffix_dedup, toxicity
from tracewell.llm.common import ARROW_BATCH, forget, fresh, small_batches, stored, table


def in_small_batches(stage):
    @wraps(stage)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return staged


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores 0.5 or more go."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~toxicity.held_out("doc_id"))
    model = toxicity.fit(docs, labels)
    out = fresh(docs, "__score")
    return toxicity.score(docs, model, out=out).where(F.col(out) < 0.5).select(*docs.columns)


@in_small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link (5-word shingles, similarity 0.8) the least id stays, and one row of each repeated document."""
    found = ngram_join.components(docs, n=5, percent=80)
    ids = stored(found.groupBy("doc_id").agg(F.bool_or(F.col("component_id") != F.col("doc_id")).alias("gone"), F.count("*").alias("n")).where("gone OR n > 1"))
    forget(found)
    once = docs.join(ids.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    again = docs.join(ids.where("NOT gone").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(again.select(*docs.columns))


@in_small_batches
def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id holds too are cut out of the text.

    A document of which only white space is left goes.
    """
    aside = {c: fresh(docs, f"__{c}") for c in docs.columns if c.lower() in suffix_dedup.MADE}  # columns named like the operator's own
    out = suffix_dedup.remove(docs.withColumnsRenamed(aside), size=50, characters=True)
    text = F.when(F.col("n_removed") > 0, F.decode("kept", "UTF-8")).otherwise(F.col("text"))
    left = out.withColumn("text", text).where((F.col("n_removed") == 0) | F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


@in_small_batches
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes."""
    out = fresh(docs, "__secrets")
    found = secret_scan.scan(docs, out=out)
    text = F.when(F.size(out) > 0, secret_scan.mask(F.col("text"), F.col(out))).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenised pieces of the documents and their places in sequences of 2048."""
    import public_tokenizers

    pieces = stored(packing.tokenise(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False))
    return packing.pack(pieces)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: A trained model, set joins and packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    given = spark.conf.getAll.get(ARROW_BATCH)
    try:
        for _, stage in STAGES:
            before, docs = docs, stored(stage(spark, docs, sf_dir))
            forget(before)  # nothing of the input table, which is not stored here
    finally:
        if given is None:
            spark.conf.unset(ARROW_BATCH)
    return docs
