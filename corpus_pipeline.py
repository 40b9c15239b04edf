"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir).  ``docs`` has the columns of
``documents``; other columns are dropped.  All stages but the last return these
columns again.  Null and empty texts are clean documents and pass all filters;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import common, decontamination, minhash, packing, pii, toxicity
from quillstone.llm.queries import KEY, word_bpe

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words in a shingle of the near-duplicate stage, and the least similarity in percent.
SHINGLE, SIMILARITY = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject.

    It learns from ``labels`` outside the held-out fifth.
    """
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, toxicity.toxic_labels(common.table(spark, sf_dir, "labels", "doc_id", "toxic")))
    out = toxicity.drop_toxic(docs, model)
    del model  # executors have it; the driver gives its memory back before the stage runs
    common.give_back()
    return out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each group of near-duplicates.

    Of rows that share a doc_id the least by text, lang, source and n_chars
    stays; rows without doc_id all stay.
    """
    docs = docs.select(*COLUMNS)
    gone = minhash.near_duplicates(docs, SHINGLE, SIMILARITY).where(~F.col("kept")).select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    named = docs.where("doc_id IS NOT NULL")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    least = kept.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row"))
    return least.select("doc_id", "row.*").select(*COLUMNS).unionByName(kept.where("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window at all.

    Rows are told apart by doc_id and text, so a null or repeated doc_id is no matter.
    """
    docs = docs.select(*COLUMNS)
    key = F.xxhash64("doc_id", "text")
    keyed = docs.select(key.alias("doc_id"), "text")
    found = decontamination.decontaminate(keyed, common.table(spark, sf_dir, "benchmark", "item_id", "text"))
    gone = found.where("n_hit > 0").select(F.col("doc_id").alias("row")).dropDuplicates()
    return docs.withColumn("row", key).join(gone, "row", "left_anti").select(*COLUMNS)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses replaced by keyed pseudonyms; n_chars follows the text."""
    out = pii.pseudonymise(docs.select(*COLUMNS), KEY)
    changed = F.size("pii_kinds") > 0
    return out.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(docs.select("doc_id", "text"), word_bpe())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", pseudonymise),
    ("packing", pack),
]
#: SQL cannot tokenise or fit a classifier; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a table in the shared folder."""
    docs = common.table(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = common.scratch(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
