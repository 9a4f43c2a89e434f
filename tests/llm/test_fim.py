"""Fill-in-middle texts against a plain cut by a regular expression, and back again."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brindle.llm import fim, queries
from tests.llm.fixtures import documents, empty
from tests.oracle import both

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_fim(i, text, seed=42, percent=50, spm=80, markers=("<P>", "<S>", "<M>")):
    text, units = text or "", UNIT.findall(text or "")
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in markers) or h[2] % 100 >= percent:
        return i, len(units), "plain", None, None, text
    x, y, z = markers
    form = "spm" if h[3] % 100 < spm else "psm"
    return i, len(units), form, len(p), len(m), y + s + x + p + z + m if form == "spm" else x + p + y + s + z + m


ODD = ["", None, " ", " \t\n\r\x0b\x0c ", "a", " a", "a ", "a  b\n", "\x01", "\x02", "\x02d\x01 \x02e \x01\x01 e", "\x02\x02d d", "$0 \\ $1", "has <P> in", "x<S>", "<M>", "< P> <", "<S <", "é𝄞  x\x85y\xa0z", "\x1c \x1f", "<" * 50 + " S>", "w " * 5000]


@pytest.mark.parametrize("by", [{}, {"percent": 100}, {"percent": 100, "spm": 0}, {"percent": 100, "seed": 7, "markers": ("[pre]", "{suf}", "(mid)")}])
def test_texts_match_a_plain_cut_and_come_back(spark, by):
    rows = [(i, t) for i in (0, 40, 80) for i, t in enumerate(ODD, i)] + [(None, "no id a b c"), (3, "again one id")]
    d = spark.createDataFrame([(*r, 7, "x", "y") for r in rows], "doc_id bigint, text string, n int, form string, _digest string").repartition(3)
    made = fim.fill_in_middle(d, **by)
    assert Counter(tuple(r) for r in made.collect()) == Counter(plain_fim(*r, **by) for r in rows)
    back = made.select("doc_id", fim.restored(F.col("output"), F.col("form"), by.get("markers", ("<P>", "<S>", "<M>"))).alias("t"))
    assert Counter(tuple(r) for r in back.collect()) == Counter((i, t or "") for i, t in rows)


def test_fixture_and_nothing(spark):
    d, rows = documents(spark)
    assert Counter(tuple(r) for r in fim.fill_in_middle(d).collect()) == Counter(plain_fim(r[0], r[1]) for r in rows)
    assert fim.fill_in_middle(empty(spark)).count() == 0


@pytest.mark.parametrize("markers", [("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P>", "P", "<M>"), ("<<", "<S>", "<M>")])
def test_markers_that_could_not_be_told_apart(spark, markers):
    with pytest.raises(ValueError):
        fim.fill_in_middle(empty(spark), markers=markers)


def test_no_python_runs(spark):
    d, _ = documents(spark)
    assert "Python" not in fim.fill_in_middle(d)._jdf.queryExecution().executedPlan().toString()


def test_the_given_documents_match_sql(spark):
    ours, theirs = both(spark, queries.op13_fill_in_middle, queries.ORACLES["op13_fill_in_middle"], "/root/testdata/sf0.01")
    assert ours == theirs
