"""Requests by path, their errors, the command line and the SQL functions."""

import json
import threading
import urllib.request

import pytest

from brindle import cli
from brindle.functions import sql
from brindle.service import Monitor, Service, serve


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at, source = str(tmp_path_factory.mktemp("tables")), tmp_path_factory.mktemp("in")
    (source / "a.md").write_text("Bitcoin price target.\n\nMining bitcoin blocks slowly.")
    (source / "b.txt").write_text("Running miners mine blocks.")
    (source / "c.json").write_text("{broken")
    assert cli.init(spark, at) == list(cli.EMPTY) and cli.init(spark, at) == []
    cli.ingest(spark, str(source), at)
    cli.ingest(spark, str(source), at)
    return at, source


@pytest.fixture(scope="module")
def service(spark, folder):
    e = cli.opened(spark, folder[0])
    e.tables["entities"] = spark.createDataFrame([("a", "A", "t", None), ("b", "B", "t", None)], cli.EMPTY["entities"])
    e.tables["relations"] = spark.createDataFrame([("a", "b", "R", 1.0)], cli.EMPTY["relations"])
    return Service(e, spark.createDataFrame([("BTC", "bitcoin")], "domain string, keyword string"))


def test_the_same_files_at_another_time_are_no_new_documents(spark, folder):
    assert cli.opened(spark, folder[0]).stats()["documents"] == 2
    with pytest.raises(SystemExit):
        raise SystemExit(cli.main([]))


def test_paths(service):
    assert service.handle("/health") == (200, {"status": "ok", "tables": dict.fromkeys(sorted(cli.EMPTY), True)})
    assert service.handle("/stats")[1]["documents"] == 2
    code, hits = service.handle("/search", {"q": "miners", "mode": "keyword"})
    assert code == 200 and len(hits) == 1
    assert len(service.handle("/documents", {"limit": "1"})[1]) == 1
    key = service.handle("/documents")[1][0]["document_id"]
    assert service.handle("/documents", {"id": key})[1]["document_id"] == key
    assert service.handle("/detect-domain", {"text": "bitcoin rises"})[1][0]["domain"] == "BTC"
    assert service.handle("/graph/traverse", {"start": "a"})[1] == {"nodes": [{"id": "a", "depth": 0}, {"id": "b", "depth": 1}], "edges": [{"src": "a", "dst": "b", "relation_type": "R"}], "edges_total": 1}
    assert service.handle("/graph/entity", {"id": "b"})[1]["relations"][0]["direction"] == "in"
    assert len(service.handle("/graph/edges")[1]) == 1
    assert service.handle("/search/reranked", {"q": "bitcoin price"})[0] == 200
    assert any(x.startswith('brindle_calls_total{op="/stats"}') for x in service.handle("/metrics")[1])


@pytest.mark.parametrize("path,params,code,status", [("/nowhere", {}, 404, "NOT_FOUND"), ("/search", {}, 400, "INVALID_ARGUMENT"), ("/search", {"q": "x", "limit": "many"}, 400, "INVALID_ARGUMENT"), ("/search", {"q": "x", "mode": "other"}, 400, "INVALID_ARGUMENT"), ("/documents", {"id": "none"}, 404, "NOT_FOUND"), ("/documents", {"limit": "0"}, 400, "INVALID_ARGUMENT")])
def test_errors_have_one_form(service, path, params, code, status):
    got, body = service.handle(path, params)
    assert (got, body["error"]["code"], body["error"]["status"]) == (code, code, status) and body["error"]["message"]


def test_a_server_answers(service):
    s = serve(service, port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{s.server_address[1]}/graph/edges?limit=5") as r:
        assert json.load(r) == [{"src": "a", "dst": "b", "relation_type": "R"}]
    s.shutdown()


def test_failures_are_counted():
    m = Monitor()

    @m.counted("x")
    def f(bad):
        if bad:
            raise KeyError

    f(False)
    with pytest.raises(KeyError):
        f(True)
    assert m.calls["x"][:2] == [2, 1]


def test_sql_functions(spark):
    assert len(sql.register(spark)) == len(sql.FUNCTIONS)
    assert spark.sql("SELECT br_tokens('A b-c'), br_jaccard(array('a', 'b'), array('b')), br_squash(1D), br_preview('abc', 2)").first()[:] == (["a", "b", "c"], 0.5, 0.5, "ab...")


def test_communities_pages_and_questions_without_words(spark, folder):
    e = cli.opened(spark, folder[0])
    e.tables["entities"] = spark.createDataFrame([(f"e{i}", f"N{i}", "t", "big" if i % 3 else "small") for i in range(9)] + [("x", "X", "t", None), ("y", "Y", "t", "one")], cli.EMPTY["entities"])
    e.tables["relations"] = spark.createDataFrame([("hub", f"n{i:04d}", "R", 1.0) for i in range(1500)], cli.EMPTY["relations"])
    s = Service(e)
    body = s.handle("/graph/communities")[1]
    assert [(c["community_id"], c["entity_count"]) for c in body["communities"]] == [("big", 6), ("small", 3)] and body["communities_total"] == 2
    body = s.handle("/graph/communities/detail", {"id": "small"})[1]
    assert [m["id"] for m in body["members"]] == ["e0", "e3", "e6"] and body["members_total"] == 3 and "N0" in body["summary"]
    assert s.handle("/graph/communities/detail", {"id": "none"})[0] == 404
    # more edges than an answer holds are told and can be asked for
    first = s.handle("/graph/traverse", {"start": "hub", "limit": "1000"})[1]
    assert len(first["edges"]) == first["edges_total"] == 999
    assert len(s.handle("/graph/traverse", {"start": "hub", "limit": "1000", "offset": "990"})[1]["edges"]) == 9
    for mode in ("keyword", "hybrid"):
        assert s.handle("/search", {"q": "?!", "mode": mode})[0] == 200
    assert s.handle("/search", {"q": "?!", "mode": "keyword"})[1] == []


def test_requests_leave_no_tables_behind(spark, folder):
    import os

    from brindle.shared import shared_dir

    e = cli.opened(spark, folder[0])
    e.index = None  # every keyword search writes a table then
    s, at = Service(e), shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(at))
    for _ in range(10):
        assert s.handle("/search", {"q": "miners", "mode": "keyword"})[0] == 200
    assert s.handle("/search", {"q": "miners", "mode": "other"})[0] == 400
    assert set(os.listdir(at)) == before


def test_the_index_follows_ingest_and_delete(spark, folder):
    e = cli.opened(spark, folder[0])
    assert e.index is not None
    plain = cli.opened(spark, folder[0])
    plain.index = None
    key = lambda d: sorted((r.id, r.score) for r in d.collect())
    for q in ("miners", "bitcoin price", "nothing here"):
        assert key(e.keyword(q)) == key(plain.keyword(q))
    hit = e.keyword("running").first().id
    e.delete_document(e.tables["chunks"].where(e.tables["chunks"].chunk_id == hit).first().document_id)
    assert e.keyword("running").count() == 0


def test_failures_are_logged(spark, caplog):
    from brindle.engine import Engine

    s = Service(Engine(spark, {}))
    assert s.handle("/graph/edges")[0] == 500 and "request /graph/edges failed" in caplog.text
