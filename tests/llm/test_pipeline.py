"""The pipeline's stages, each on its own input, and the queries of the operators."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from brindle.llm import queries
from brindle.llm.exact_dedup import exact_dedup
from brindle.llm.minhash import near_duplicates
from brindle.llm.suffix_dedup import suffix_dedup
from tests.llm.fixtures import documents, empty
from tests.oracle import both

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, name):
    ours, theirs = both(spark, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert ours == theirs


def test_all_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))


def test_stages_decide_on_all_they_get(spark):
    d, rows = documents(spark)
    d = d.where("doc_id is null or doc_id > 0")
    rows = [r for r in rows if r[0] is None or r[0] > 0]
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda x: sorted(r["doc_id"] for r in x.where("doc_id is not null").select("doc_id").collect())
    assert ids(stages["exact dedup"](spark, d, SF)) == ids(exact_dedup(d).where("kept"))
    assert ids(stages["near dedup"](spark, d, SF)) == ids(near_duplicates(d).where("kept"))
    cut = stages["suffix-array dedup"](spark, d, SF)
    want = {r["doc_id"]: r["text"] for r in suffix_dedup(d, with_text=True).collect()}
    got = {r["doc_id"]: r for r in cut.collect()}
    assert {k: v["text"] for k, v in got.items()} == want and len(got) == len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d, SF).columns == d.columns, name
        assert stage(spark, empty(spark), SF).count() == 0, name
        assert stage(spark, d, SF).where("doc_id is null").count() <= 1
    assert corpus_pipeline.packing(spark, empty(spark), SF).count() == 0


def test_repeated_rows_are_one_document(spark):
    d = spark.createDataFrame([(1, "a b c d e f", "en")] * 3 + [(2, "other words in this one", "en")], "doc_id bigint, text string, lang string")
    assert corpus_pipeline.drop_copies(spark, d, SF).count() == 2


def test_columns_of_any_kind_go_through(spark):
    d, _ = documents(spark)
    d = d.where("doc_id between 40 and 60").withColumn("m", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("r", F.struct("lang", F.array("score").alias("a"))).withColumn("spans", F.lit(None).cast("string"))
    d = d.union(d.limit(2))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns and [x.dataType for x in out.schema] == [x.dataType for x in d.schema], name
        assert all(x["m"] == {"k": x["doc_id"]} for x in out.collect()), name
    assert corpus_pipeline.packing(spark, d, SF).count() >= d.count()


def test_run_matches_brute_force(spark, tmp_path):
    """The rows that the classifier accepts, then every other stage by hand, over a table of copies, near copies and shared passages."""
    import re
    from collections import Counter, defaultdict

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from brindle.llm.minhash import shingle_set
    from brindle.llm.quality_model import accept

    d, _ = documents(spark)
    d = d.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id > 0")
    labels = spark.createDataFrame([(i, int(i < 85), 0) for i in range(1, 100)], "doc_id bigint, quality int, toxic int")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = {r["doc_id"]: r["text"] or "" for r in accept(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels).collect()}
    groups = defaultdict(list)
    for i, t in rows.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i))
    rows = {i: rows[i] for _, i in map(min, groups.values())}
    sets, part = {i: set(shingle_set(t).tolist()) for i, t in rows.items()}, {i: i for i in rows}
    for a in rows:
        for b in rows:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((part[a], part[b]))
                part = {k: low if v == high else v for k, v in part.items()}
    rows = {i: t for i, t in rows.items() if part[i] == i}
    raws = {i: t.encode() for i, t in rows.items()}
    seen = Counter(b[p : p + 200] for b in raws.values() for p in range(len(b) - 199))
    for i, b in raws.items():
        gone = {x for p in range(len(b) - 199) if seen[b[p : p + 200]] > 1 for x in range(p, p + 200)}
        raws[i] = bytes(c for k, c in enumerate(b) if k not in gone)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(t.encode(b.decode("utf-8", "ignore"), add_special_tokens=False).ids) + 1 for i, b in raws.items()}
    got, places = corpus_pipeline.run(spark, str(tmp_path)).collect(), defaultdict(list)
    assert {r["doc_id"]: r["doc_tokens"] for r in got} == want
    for r in got:
        places[r["doc_id"]] += range(r["start"], r["start"] + r["length"])
    assert all(sorted(x) == list(range(want[i])) for i, x in places.items())
    assert len(want) < 100 and np.mean(list(want.values())) > 10


def test_run_keeps_clean_documents(spark):
    out = corpus_pipeline.run(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    firsts = exact_dedup(docs).where("kept").join(near_duplicates(docs).where("kept"), "doc_id", "left_semi")
    good = labels.where("quality = 1").join(firsts, "doc_id", "left_semi")
    left = out.select("doc_id").distinct()
    assert good.join(left, "doc_id", "left_anti").count() <= 0.05 * good.count()
    assert out.agg(F.count_distinct("doc_id")).first()[0] == left.count()
