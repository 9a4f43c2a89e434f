"""A stored full-text index that follows its table: segments of postings, deletes by tombstone, merging.

Appending indexes the new documents alone, as one more segment. Deleting lists
ids: a listed id counts in no segment made before. Changing a document is both.
Merging writes the live postings of all segments as one, from the postings, so
no text is read again. Every step is a new manifest (see ``snapshots``).
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import index
from brindle.operators.snapshots import Manifests


class IndexStore:
    def __init__(self, spark: SparkSession, path: str, stemmed: bool = True):
        self.spark, self.path, self.stemmed, self.manifests = spark, path.rstrip("/"), stemmed, Manifests(spark, f"{path.rstrip('/')}/_manifests")

    def _now(self) -> tuple[int, dict]:
        return self.manifests.read() if self.manifests.versions() else (-1, {"steps": []})

    def _add(self, *steps: dict) -> int:
        version, what = self._now()
        self.manifests.write(version + 1, {"steps": what["steps"] + list(steps)})
        return version + 1

    def _segment(self, made: index.Index) -> dict:
        name = f"segments/{uuid.uuid4().hex}"
        made.save(f"{self.path}/{name}")
        return {"segment": name}

    def _tombs(self, ids: DataFrame) -> dict:
        name = f"tombs/{uuid.uuid4().hex}"
        ids.select("id").distinct().write.parquet(f"{self.path}/{name}")
        return {"tombs": name}

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> int:
        """Index documents whose ids are not indexed yet."""
        return self._add(self._segment(index.build(docs, self.stemmed, id_col, text_col)))

    def delete(self, ids: DataFrame) -> int:
        """Leave out the documents of ``id``."""
        return self._add(self._tombs(ids))

    def update(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> int:
        """Index documents in place of those of their ids, in one step."""
        return self._add(self._tombs(docs.select(F.col(id_col).alias("id"))), self._segment(index.build(docs, self.stemmed, id_col, text_col)))

    def index(self) -> index.Index:
        """The live postings and lengths, to be searched like any index; the totals are those of live documents."""
        steps = self._now()[1]["steps"]
        if not any("segment" in s for s in steps):
            raise ValueError("nothing is indexed")
        parts = {"postings": [], "lengths": []}
        for i, step in enumerate(steps):
            if "segment" not in step:
                continue
            gone = [self.spark.read.parquet(f"{self.path}/{s['tombs']}") for s in steps[i:] if "tombs" in s]
            dead = reduce(lambda a, b: a.union(b), gone).distinct() if gone else None
            segment = index.load(self.spark, f"{self.path}/{step['segment']}", self.stemmed)
            for name, tables in parts.items():
                d = getattr(segment, name)
                tables.append(d.join(dead, "id", "left_anti") if dead is not None else d)
        postings, lengths = (reduce(lambda a, b: a.unionByName(b), t) for t in parts.values())
        return index.Index(postings, lengths, lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")), self.stemmed)

    def merge(self) -> int:
        """All live postings as one segment; earlier ones stay on disk for those who read them."""
        version, _ = self._now()
        step = self._segment(self.index())
        self.manifests.write(version + 1, {"steps": [step]})
        return version + 1

    def segments(self) -> int:
        return sum("segment" in s for s in self._now()[1]["steps"])
