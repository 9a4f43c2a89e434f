"""What follows a JSON value makes a file no JSON."""

from pyspark.sql import functions as F

from brindle.sources import files

TEXTS = {"7": True, ' {"a": [1, "x"]}\n': True, "[]": True, "7 words": False, '{"a": 1} b': False, "1,2": False, "1],[2": False, '1,"b":2': False, '1},{"v":2': False, "1}": False, "": False, "  ": False}


def test_file_validation_takes_one_value_and_nothing_after_it(spark):
    d = spark.createDataFrame([(f"{i}.json", len(t), bytearray(t.encode())) for i, t in enumerate(TEXTS)], "path string, length bigint, content binary")
    got = {int(r["path"][:-5]): r["error"] for r in files.checked(d).collect()}
    assert [got[i] for i in range(len(TEXTS))] == [None if ok else "empty file" if t == "" else "not json" for t, ok in TEXTS.items()]


def test_file_route_leaves_out_text_that_begins_with_a_number(spark):
    d = spark.createDataFrame([("a.json", 9, bytearray(b"12 a text")), ("b.json", 8, bytearray(b'{"n": 1}'))], "path string, length bigint, content binary")
    assert [r["path"] for r in files.route(files.checked(d), "T").select(F.col("path")).collect()] == ["b.json"]
