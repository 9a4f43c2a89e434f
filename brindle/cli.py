"""The command line over a folder of tables.

python -m brindle.cli init OUT
python -m brindle.cli ingest FOLDER OUT
python -m brindle.cli search OUT QUERY [MODE]
python -m brindle.cli stats OUT
python -m brindle.cli serve OUT [PORT]
"""

from __future__ import annotations

import os
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from brindle.engine import Engine
from brindle.operators.segments import IndexStore
from brindle.session import session

EMPTY = {
    "documents": "document_id string, content_hash string, text string, source_uri string, domain string",
    "chunks": "document_id string, chunk_index bigint, text string, char_count bigint, token_count bigint, chunk_id string, embedding array<double>",
    "entities": "id string, name string, entity_type string, community string", "relations": "src string, dst string, relation_type string, confidence double", "mentions": "chunk_id string, entity_id string",
}


def opened(spark: SparkSession, folder: str) -> Engine:
    """The engine over a folder's tables; those that are missing are empty."""
    have = {n: spark.read.parquet(f"{folder}/{n}.parquet") if os.path.isdir(f"{folder}/{n}.parquet") else spark.createDataFrame([], kind) for n, kind in EMPTY.items()}
    return Engine(spark, have, index=held if (held := indexed(spark, folder)).manifests.versions() else None)


def indexed(spark: SparkSession, folder: str) -> IndexStore:
    return IndexStore(spark, f"{folder}/index", stemmed=False)


def init(spark: SparkSession, folder: str) -> list[str]:
    """Write what is missing as empty tables; returns their names."""
    new = [n for n in EMPTY if not os.path.isdir(f"{folder}/{n}.parquet")]
    for n in new:
        spark.createDataFrame([], EMPTY[n]).write.parquet(f"{folder}/{n}.parquet")
    return new


def ingest(spark: SparkSession, source: str, folder: str) -> None:
    """Append the new documents of ``source`` and their chunks to the tables; tells the files that failed."""
    e = opened(spark, folder)
    e.index = None  # the index follows the tables, below
    known = {n: d.select(*d.columns) for n, d in e.tables.items()}
    e.ingest(source, datetime.now(UTC).isoformat()).show(truncate=False)
    ids = e.tables["documents"].join(known["documents"].select("document_id"), "document_id", "left_anti")
    made = e.tables["chunks"].join(ids.select("document_id"), "document_id", "left_semi")
    held = indexed(spark, folder)
    # an update, so that an ingest that is repeated after a failure does no harm
    held.update(made if held.manifests.versions() else known["chunks"].unionByName(made), "chunk_id")
    made.write.mode("append").parquet(f"{folder}/chunks.parquet")
    ids.write.mode("append").parquet(f"{folder}/documents.parquet")


def main(args: list[str]) -> int:
    least = {"init": 2, "ingest": 3, "search": 3, "stats": 2, "serve": 2}
    if not args or len(args) < least.get(args[0], 99):
        print(__doc__)
        return 2
    spark = session()
    if args[0] == "init":
        print("\n".join(init(spark, args[1])))
    elif args[0] == "ingest":
        ingest(spark, args[1], args[2])
    elif args[0] == "search":
        opened(spark, args[1]).search(args[2], *args[3:4]).show(truncate=False)
    elif args[0] == "stats":
        for name, n in opened(spark, args[1]).stats().items():
            print(name, n)
    else:
        from brindle.service import Service, serve

        serve(Service(opened(spark, args[1])), port=int(args[2]) if len(args) > 2 else 8000).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
