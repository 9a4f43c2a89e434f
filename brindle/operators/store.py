"""Stores as immutable tables: lookups, filters, upserts, deletes, pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def metadata_filter(where: dict) -> Column:
    """Equality, ``$in``, ``$gte``, ``$lte`` and ``$contains`` on columns, all of which must hold."""
    ops = {"$in": lambda c, v: c.isin(*v), "$gte": lambda c, v: c >= v, "$lte": lambda c, v: c <= v, "$contains": lambda c, v: c.contains(v), "$eq": lambda c, v: c == v}
    out = [ops[op](F.col(name), v) for name, cond in where.items() for op, v in (cond if isinstance(cond, dict) else {"$eq": cond}).items()]
    return reduce(lambda a, b: a & b, out, F.lit(True))


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``base`` with those of ``changes`` in place of equal keys. Only keys that change are looked up: no window over the base."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes)


def newest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the highest version of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).where("_r = 1").drop("_r")


def resolve_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges whose endpoints, given by name, both exist; names become ids. Of several entities of a name the smallest id is taken."""
    ids = entities.groupBy("name").agg(F.min("id").alias("id"))
    out = edges.join(ids.select(F.col("name").alias("src_name"), F.col("id").alias("src")), "src_name")
    return out.join(ids.select(F.col("name").alias("dst_name"), F.col("id").alias("dst")), "dst_name")


def delete_cascade(parents: DataFrame, keys: DataFrame, key: str, *children: DataFrame) -> list[DataFrame]:
    """Every table without the rows that belong to the deleted keys."""
    return [t.join(keys.select(key), key, "left_anti") for t in (parents, *children)]


def page(d: DataFrame, order: list, offset: int = 0, limit: int = 100) -> DataFrame:
    """One page by a total order; a limit lies in 1..1000."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must lie in 1..1000 and offset must not be negative")
    return d.orderBy(*order).offset(offset).limit(limit)


def page_numbers(d: DataFrame, limit: int) -> DataFrame:
    """One row: totals and the number of pages."""
    return d.agg(F.count(F.lit(1)).alias("total")).select("total", F.ceil(F.col("total") / limit).cast("bigint").alias("pages"), (F.col("total") > limit).alias("has_more"))


def union_first(lists: list[DataFrame], key: str) -> DataFrame:
    """Union of lists in which a key stays as its first list has it."""
    all_ = reduce(lambda a, b: a.unionByName(b), [d.withColumn("_at", F.lit(i)) for i, d in enumerate(lists)])
    return all_.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_at"))).where("_r = 1").drop("_at", "_r")


def with_documents(hits: DataFrame, docs: DataFrame, key: str = "id", limit: int | None = None) -> DataFrame:
    """Hits (``id, score``) with their documents' columns, best first; hits without a document are left out before the cut."""
    out = hits.join(docs, key)
    return out.orderBy(F.desc("score"), key).limit(limit) if limit else out


def append(rows: DataFrame, path: str) -> None:
    """Add rows to a Parquet table, which begins with the first of them."""
    rows.write.mode("append").parquet(path)


def get_vectors(vectors: DataFrame, ids: list | None = None, where: dict | None = None, limit: int | None = None, id_col: str = "vec_id") -> DataFrame:
    """Vectors by ids and metadata, the first ``limit`` by id."""
    d = vectors.where(F.col(id_col).isin(*ids)) if ids is not None else vectors
    d = d.where(metadata_filter(where)) if where else d
    return d.orderBy(id_col).limit(limit) if limit else d
