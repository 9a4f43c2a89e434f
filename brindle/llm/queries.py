"""The operators' queries over whole tables, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import oracles
from brindle.llm.bpe import bpe_round_trip
from brindle.llm.clustering import cluster
from brindle.llm.exact_dedup import exact_dedup
from brindle.llm.fim import fill_in_middle, restored
from brindle.llm.html_main import extract_main_text
from brindle.llm.licenses import license_scan
from brindle.llm.minhash import near_duplicates
from brindle.llm.packing import pack
from brindle.llm.quality_model import quality_scores
from brindle.llm.quality_rules import quality_rules
from brindle.llm.simhash import simhash_clusters
from brindle.llm.suffix_dedup import suffix_dedup
from brindle.llm.token_records import token_records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op6_exact_dedup",
    r"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
    ), r AS (
      SELECT doc_id, norm,
             first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY norm) AS group_size
      FROM d
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
    """,
)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among all documents; one row per document."""
    return exact_dedup(_table(spark, sf_dir, "documents"))


@query("op2_license_scan", oracles.license_scan_sql())
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices and texts in all documents; one row per document."""
    return license_scan(_table(spark, sf_dir, "documents"), passages=True)


@query("op3_quality_rules", oracles.quality_rules_sql())
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and risk-controlled quality rules over all documents; one row per document."""
    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query("op5_token_records")
def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to record files and read back; one row per document."""
    _, records = token_records(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return records.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), "part", "record")


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens; one row per piece."""
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048)


@query("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded; one row per document."""
    return bpe_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op4_main_text")
def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages; one row per page."""
    return extract_main_text(_table(spark, sf_dir, "pages"))


@query("op9_quality_model")
def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; one row per document."""
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query("op1_minhash", oracles.MINHASH)
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all documents; one row per document."""
    return near_duplicates(_table(spark, sf_dir, "documents"), size=4)


@query("op7_suffix_dedup", oracles.SUFFIX)
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 200-byte strings of all documents; one row per document."""
    return suffix_dedup(_table(spark, sf_dir, "documents"))


@query("op11_simhash")
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents; one row per document."""
    return simhash_clusters(_table(spark, sf_dir, "documents"))


@query("op12_clusters", oracles.clusters_sql())
def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable vectors in 40 clusters; one row per vector."""
    return cluster(_table(spark, sf_dir, "embeddings"))


@query("op13_fill_in_middle", oracles.FILL_IN_MIDDLE)
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as fill-in-middle texts, with the digest of what is rebuilt from them; one row per document."""
    made = fill_in_middle(_table(spark, sf_dir, "documents"))
    rebuilt = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(rebuilt, 256).alias("restored_sha256"))
