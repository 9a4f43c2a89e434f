import json

import pytest

from brindle import config
from brindle.engine import Engine, provider, recommend
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("in")
    (folder / "a.md").write_text("Bitcoin price target.\n\nMining bitcoin blocks slowly.")
    (folder / "b.txt").write_text("Running miners mine blocks.")
    (folder / "b2.txt").write_text("Running miners mine blocks.")
    (folder / "c.xyz").write_text("?")
    e = Engine(spark, settings=config.load(chunk_size=10, max_chunk_size=30, chunk_overlap=0))
    failed = e.ingest(str(folder), "T")
    assert [r["error"] for r in failed.collect()] == ["unsupported extension"]
    e.tables = {k: d.cache() for k, d in e.tables.items()}
    e.tables["mentions"] = e.tables["chunks"].select("chunk_id", F.lit("e:1").alias("entity_id"))
    return e


def test_ingest_keeps_one_of_equal_contents(engine):
    assert engine.tables["documents"].count() == 2
    assert engine.stats()["chunks"] >= 3


@pytest.mark.parametrize("mode", ["keyword", "semantic", "hybrid", "dual"])
def test_search_modes(engine, mode):
    found = engine.search("miners mine?", mode, 3)
    # graph chunks have a constant score above every direct one
    found = found.where("origin = 'direct'") if mode == "dual" else found
    top = found.orderBy(F.desc("score")).first()
    text = engine.tables["chunks"].where(F.col("chunk_id") == top["id"]).first()["text"]
    assert "miners" in text


def test_rerank_many_context_corrective(engine):
    assert engine.reranked("bitcoin price").first()["ce"] > 0
    assert engine.many(["bitcoin", "mining blocks"], 2).count() == 2
    assert "[Source 1 - " in engine.context("bitcoin price").first()["prompt"]
    assert engine.corrective("bitcoin price").where("verdict = 'correct'").count() >= 1
    with pytest.raises(ValueError):
        engine.search("x", "other")


def test_dual_search_adds_the_largest_communities(engine):
    from brindle.engine import Engine

    spark = engine.spark
    other = engine.tables["chunks"].select("chunk_id").orderBy("chunk_id").collect()
    rows = [(r["chunk_id"], f"e:{i}") for i, r in enumerate(other)]
    e = Engine(spark, engine.tables | {"mentions": spark.createDataFrame(rows, "chunk_id string, entity_id string"), "entities": spark.createDataFrame([(x, x, "t", "c") for _, x in rows], "id string, name string, entity_type string, community string")}, engine.settings)
    got = {r["id"]: r["origin"] for r in e.dual("bitcoin", 1).collect()}
    assert set(got) == {r["chunk_id"] for r in other} and list(got.values()).count("direct") == 1 and "community" in got.values()


def test_rerank_checks_its_arguments(engine):
    from brindle import config
    from brindle.engine import Engine

    with pytest.raises(ValueError):
        engine.reranked(" ")
    with pytest.raises(ValueError):
        Engine(engine.spark, engine.tables, config.load(initial_top_k=3, final_top_k=5)).reranked("x")


def test_sql_passthrough_and_delete(engine):
    assert engine.query("SELECT count(*) AS n FROM documents WHERE text LIKE :p", p="%itcoin%").first()["n"] == 1
    other = Engine(engine.spark, engine.tables)
    key = other.tables["documents"].first()["document_id"]
    other.delete_document(key)
    assert other.tables["documents"].count() == 1 and other.tables["chunks"].where(F.col("document_id") == key).count() == 0


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"rrf_k": 30, "unknown": 1}))
    s = config.load(str(tmp_path / "c.json"), final_top_k=5)
    assert (s.rrf_k, s.final_top_k, s.chunk_size) == (30, 5, 1000)


def test_model_choice(spark):
    d = spark.createDataFrame([("gpt-x", "t", 2, True), ("a", "t", 1, False), ("llama-y", "t", 1, True)], "name string, task string, priority int, healthy boolean")
    assert recommend(d).first()["name"] == "llama-y"
    assert [r[0] for r in d.select(provider(F.col("name"))).collect()] == ["gpt", "", "llama"]
