"""Exact deduplication in three combining steps, with DataFrame functions only.

Texts are equal when they are identical without ASCII white space. Each step
groups by digest *and* full normalised content, so equal digests of different
texts never merge:

1. each map task combines its own copies (Spark's partial aggregation), so a
   group sends one row per task however large it is;
2. those rows meet by (digest, content, salt), the salt being the task's number
   modulo ``salts``: a group found in every task spreads over ``salts`` reducers;
3. the salts' winners meet by (digest, content).

The verdict goes back to the documents over the digest alone, which is narrow;
Spark splits that join's hot partitions at run time. Should one digest stand for
several contents, its documents take a second path that joins on the content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import Written, text_of

#: One decimal holds (code points, id): more code points win, then the smaller id.
_STEP = "100000000000000000000"
_TOP = "9223372036854775807"


def normalised(text: Column) -> Column:
    return F.translate(text, " \t\n\x0b\x0c\r", "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest=None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the most code points stays, then the one with
    the smallest id. A null text is an empty one; a null id comes after all
    others and may be the ``keep_id`` of a group of null ids only. Rows that
    repeat an id are rows of their own and count in ``group_size``; those that
    repeat the winner's id and length are all kept. An empty table gives an
    empty result; other columns are ignored, whatever their names. ``digest``
    replaces SHA-256 as the grouping digest (a Column to a Column).
    """
    key = digest or (lambda c: F.sha2(c, 256))
    text = text_of(docs, text_col)
    base = docs.select(docs[id_col].cast("bigint").alias("_id"), F.length(text).alias("_n"), normalised(text).alias("_norm"))
    base = base.select("_id", "_n", "_norm", key(F.col("_norm")).alias("_key"))
    order = F.expr(f"cast(_n as decimal(38,0)) * {_STEP}BD + coalesce({_TOP}BD - _id + 1BD, 0BD)").cast("decimal(38,0)")
    local = (
        base.select("_key", "_norm", order.alias("_o"), (F.spark_partition_id() % salts).alias("_salt"))
        .groupBy("_key", "_norm", "_salt")
        .agg(F.max("_o").alias("_o"), F.count(F.lit(1)).alias("_size"))
    )
    whole = local.groupBy("_key", "_norm").agg(F.max("_o").alias("_o"), F.sum("_size").alias("_size"))
    groups = whole.groupBy("_key").agg(F.count(F.lit(1)).alias("_contents"), F.max("_o").alias("_o"), F.sum("_size").alias("_size"))
    groups = Written(docs.sparkSession, "exact-dedup").table(groups, "groups")
    found = base.select("_id", "_n", "_key", F.sha2("_norm", 256).alias("_sha")).join(groups.where("_contents = 1"), "_key")
    out = found.select("_id", "_n", "_o", "_size", "_sha")
    clashes = groups.where("_contents > 1").select("_key")
    if not clashes.isEmpty():
        hard = whole.join(clashes, "_key", "left_semi")
        out = out.unionByName(base.join(hard, ["_key", "_norm"]).select("_id", "_n", "_o", "_size", F.sha2("_norm", 256).alias("_sha")))
    keep = F.expr(f"case when _o % {_STEP}BD = 0 then cast(null as bigint) else cast({_TOP}BD - _o % {_STEP}BD + 1BD as bigint) end")
    most = F.expr(f"_o div {_STEP}BD")
    return out.select(
        F.col("_id").alias("doc_id"),
        keep.alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_id").eqNullSafe(keep) & (F.col("_n") == most)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
