"""From raw documents to packed token sequences, in five stages.

Each stage takes what its predecessor kept, as written to Parquet; all but the last return the columns of
``documents``. Null texts are rejected by the first stage; rows with a null id pass the second and third stage
unchanged, since they can't be named; an empty table passes through all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortgrid.llm import jaccard, lines, mixing, packing, quality
from cohortgrid.llm.common import WORD, stored, table, tuned

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a threshold reject go."""
    tuned(spark)
    return quality.judge(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go, and documents of which no line is left."""
    tuned(spark)
    out = lines.line_dedup(docs.select(*COLUMNS)).where(F.rlike("text", F.lit(WORD)))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates stays: texts whose five-word shingles have
    a Jaccard similarity of 0.8 or more, and equal texts. Groups are of texts, so rows that share an id but not a
    group stay; of a group's rows with the smallest id, the first by text does."""
    tuned(spark)
    named = docs.select(*COLUMNS).where("doc_id IS NOT NULL").withColumn("node", F.xxhash64(F.coalesce("text", F.lit(""))))
    roots = jaccard.near_texts(named.select("text"))
    light = named.select("doc_id", "node").join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))
    light = light.groupBy("root", "doc_id").agg(F.min("node").alias("node"), F.max("node").alias("last"))
    least = stored(light.groupBy("root").agg(F.min(F.struct("doc_id", "node", "last")).alias("l")).select("root", "l.*"), "firsts")
    # Where a group has the smallest id with several texts, the first by text is looked up.
    tied = least.where("node <> last").select("root", "doc_id")
    texts = named.join(tied.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "node", "text")
    texts = texts.join(roots, "node").join(tied, ["root", "doc_id"]).groupBy("root", "doc_id").agg(F.min_by("node", "text").alias("node"))
    chosen = stored(least.where("node = last").select("doc_id", "node").unionByName(texts.select("doc_id", "node")), "firsts")
    kept = named.join(chosen, ["doc_id", "node"], "left_semi")
    one = F.row_number().over(Window.partitionBy("doc_id", "node").orderBy("text", "source", "lang"))
    return kept.withColumn("_one", one).where("_one = 1").select(*COLUMNS).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights; a document taken more than once is in as many rows."""
    tuned(spark)
    return mixing.repeated(mixing.mix(docs.select(*COLUMNS)), COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document, with its sequence and place."""
    tuned(spark)
    return packing.pack(docs.select("doc_id", "text"), packing.tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("source mix", mix_sources),
    ("packing", pack),
]

# Fingerprints and tokens can't be formed in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
