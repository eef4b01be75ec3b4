"""The corpus pipeline: language, near duplicates, benchmark leaks, mixture, token files.

Each stage takes ``(spark, docs, sf_dir)`` with the columns of ``documents`` and returns a DataFrame; all but the last return these
columns again.  ``run`` writes each stage's result to the shared folder and reads it back, so a later stage that is lost starts there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import decontam, jaccard, langid, mixing, tokens
from chronoweave.llm.common import documents, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Share of its n-grams that a document's first language must hold.
LEAST_SHARE = 0.5
SEED = 0
#: Ids (8 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    ids = written(ids, "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, with it in ``lang``; those without letters or without a main language go.

    If no document has a label to learn from, all stay as they are.
    """
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    if not model[0]:
        return docs
    kept = langid.identify(docs, model, keep=("doc_id", "text", "source", "n_chars"), least_share=LEAST_SHARE)
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 80 %): the one with the least id.

    Of rows that repeat an id and its text one stays; rows with a null id stay.
    """
    docs = docs.select(*COLUMNS)
    groups = jaccard.near_duplicates(docs)
    kept = _without(docs, groups.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct())
    repeated = written(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where((F.col("n") > 1) & F.col("doc_id").isNotNull()).select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(again)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    return decontam.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole passes, and the rest of its words as a seeded chance of one more.

    Documents without words, and rows with a null id, are not taken.
    """
    docs = docs.select(*COLUMNS)
    mix = mixing.mix_sources(docs, SEED).where("taken > 0").groupBy("doc_id").agg(F.max(F.col("taken") / F.col("size")).alias("times"))
    chance = F.pmod(F.xxhash64(F.lit(SEED), F.lit("copies"), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = mix.select("doc_id", F.floor(F.col("times") + chance).cast("int").alias("copies")).where("copies > 0")
    taken = docs.join(copies, "doc_id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select(*COLUMNS)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files of the documents, read back: place, length and checksum of each."""
    return tokens.write_tokens(docs.select(*COLUMNS), tokens.default_vocabulary()).digests()


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_files", token_files),
]

#: SQL can't express the stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
