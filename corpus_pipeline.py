"""From raw documents to packed token sequences: five stages, each one operator of ``brindle.llm``.

Every stage takes what its predecessor kept, decides on all of it and returns
the columns of ``documents``, whatever their kinds; the last returns the packed
pieces. Null texts count as empty, an empty table passes every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import Written
from brindle.llm.exact_dedup import exact_dedup
from brindle.llm.minhash import near_duplicates
from brindle.llm.packing import pack
from brindle.llm.quality_model import accept
from brindle.llm.suffix_dedup import without_repeats

#: SQL cannot express the classifier, nor the sampled token packing; the stages are tested against brute force.
ORACLE_SQL = None


def _kept(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows whose id a verdict keeps; of rows with one id and one text the first. Rows without an id pass: no verdict names them."""
    ids = verdicts.where("kept").select(F.col("doc_id").alias("_kept_id"))
    found = docs.join(ids, F.col("doc_id") == F.col("_kept_id"), "left_semi")
    once = found.withColumn("_text_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_text_hash"]).drop("_text_hash")
    return once.union(docs.where("doc_id is null"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score reaches 0.3, each by its own text: repeated rows, rows without an id and empty texts are scored like any other. Without labels all pass."""
    return accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts equal but for white space: the longest, then the least id. Repeated rows are one; all empty texts are one group. Rows that share an id share its fate."""
    return _kept(docs, exact_dedup(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of similar texts (sets of five words, 0.8): the least id. Texts without words stay. Repeated rows are one. Rows that share an id share its fate."""
    return _kept(docs, near_duplicates(docs))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with its text less the bytes of repeated 200-byte strings; a text of nothing else stays as an empty one. n_chars follows the text."""
    cut = without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows; repeated rows and rows without an id are documents of their own, an empty text is its end id."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("suffix-array dedup", drop_repeated_passages),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs, work = spark.read.parquet(f"{sf_dir}/documents.parquet"), Written(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = work.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
