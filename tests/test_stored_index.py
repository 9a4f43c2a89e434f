"""Stored indexes: texts are read once, entries are sorted run by run, lengths and totals are those of all documents."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.operators import index
from brindle.operators.segments import IndexStore

TEXTS = [(1, "b a b"), (2, None), (3, ""), (4, "c a"), (5, "?!"), (6, "a")]


def test_texts_are_read_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    d = spark.createDataFrame(TEXTS, "doc_id bigint, text string").withColumn("text", F.udf(seen, "string")("text"))
    store = IndexStore(spark, str(tmp_path / "i"), stemmed=False)
    store.append(d)
    assert read.value == len(TEXTS)
    store.update(d.where("doc_id = 4"))
    assert read.value == len(TEXTS) + 1


@pytest.mark.parametrize("merged", [False, True])
def test_lengths_and_postings_of_stored_indexes(spark, tmp_path, merged):
    d = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    store = IndexStore(spark, str(tmp_path / "i"), stemmed=False)
    store.append(d.where("doc_id < 4"))
    store.append(d.where("doc_id >= 4"))
    if merged:
        store.merge()
    own = store.index()
    assert sorted(map(tuple, own.lengths.collect())) == [(1, 3), (2, 0), (3, 0), (4, 2), (5, 0), (6, 1)]
    assert sorted((r.term, r.id, r.tf, list(r.positions)) for r in own.postings.collect()) == [("a", 1, 1, [1]), ("a", 4, 1, [1]), ("a", 6, 1, [0]), ("b", 1, 2, [0, 2]), ("c", 4, 1, [0])]
    assert tuple(own.totals.first()) == (6, 1.0)


@pytest.mark.parametrize("run", [1, 4, 100])
def test_entries_are_sorted_run_by_run(monkeypatch, run):
    monkeypatch.setattr(index, "RUN", run)
    monkeypatch.setattr(index, "SLICE", 2)
    words = [["b", "a", "b"], [], ["c", "a"], ["é", "a"], []]
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([w], pa.list_(pa.string()))], ["id", "t"]) for i, w in enumerate(words)]
    out = [r for b in index._postings(iter(batches), False, True) for r in b.to_pylist()]
    assert [(r["id"], r["tf"]) for r in out if r["term"] is None] == [(0, 3), (1, 0), (2, 2), (3, 2), (4, 0)]
    found = [(r["term"], r["id"], r["tf"], r["positions"]) for r in out if r["term"] is not None]
    assert sorted(found) == [("a", 0, 1, [1]), ("a", 2, 1, [1]), ("a", 3, 1, [1]), ("b", 0, 2, [0, 2]), ("c", 2, 1, [0]), ("é", 3, 1, [0])]
    if run == 100:
        assert found == sorted(found)
