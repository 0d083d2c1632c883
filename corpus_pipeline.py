"""The corpus pipeline: documents to token ids.

Each stage takes what the one before it kept and its decisions take effect: toxic documents go, common lines go from
the texts, one document of each group of near copies stays, the mix repeats or leaves out documents, and what is left becomes
token ids. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, classify, lines, minhash, mixing
from quillspark.llm.common import Scratch, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents scored 0.5 or more; the classifier learns from all labels of documents that are at hand."""
    model = classify.fit_on(docs, table(spark, sf_dir, "labels"), "toxic", classify.toxicity_features, F.lit(True), **classify.TOXICITY)
    return classify.keep_clean(docs, model, classify.toxicity_features)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; n_chars follows the text. Documents stay, also when nothing is left of them."""
    rows = lines.drop_common_lines(docs, 10, 1, numbers=False)
    return rows.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more; the smallest doc_id of each group stays. Texts without words are no copies, and
    an id that repeats with another text loses only copies."""
    return minhash.keep_one(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that the mix takes twice is two rows."""
    return mixing.repeat(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids and their number for each row, checked by decoding: a row whose bytes differ fails the job."""
    codec = bpe.default_codec(spark)
    rows = codec.round_trip(docs.select("doc_id", "source", "text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha")))
    rows = rows.withColumn("ok", F.sha2("decoded", 256) == F.col("sha"))
    whole = F.when(F.col("ok"), F.col("ids")).otherwise(F.raise_error(F.lit("decoded bytes differ from the text")).cast("array<int>"))
    return rows.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), whole.alias("ids"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("mixing", mix_sources),
    ("byte_bpe", byte_bpe),
]

#: Stages 1, 3 and 5 have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each one's rows written and read again."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k > 1:
            scratch.drop(STAGES[k - 1][0])
    return docs
