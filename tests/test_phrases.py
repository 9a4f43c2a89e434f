"""Phrases as one regular expression each finds them."""

import random
import re

import pytest

from brindle.operators import graph, knowledge, phrases

TEXTS = [
    "C++ and c++x, C++; a.c or c-c-c", "asp.net .net x.net.net.y net", "a a a a a, A-A a  a", "x.a.a.x.a.", "++ a++b a ++b", "", None, " \n", "of the of  the\nof the", "snake_case snake case_1 1", "İstanbul café CAFÉ cafés", "日本 日本語 x日本", "a" * 3000 + " the end of the end of the end",
]
PHRASES = ["c++", "c", "C", ".net", "net", "a a", "a", ".a.", "++", "of the", "of  the", "snake", "snake_case", "case_1", "café", "日本", "the end of the end", "one two three four five six", "x.net.net.y", "-", ", ", "", None]


def plain(text, phrase):
    return len(re.findall(r"\b" + re.escape(phrase.lower()) + r"\b", text.lower()))


def given(spark, texts=TEXTS, known=PHRASES):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string"), spark.createDataFrame([(p,) for p in known], "phrase string")


@pytest.mark.parametrize("most", [0, 3, 5000])
def test_counts_are_those_of_regular_expressions(spark, most):
    """Either side of the size at which the phrases are broadcast."""
    texts, known = given(spark)
    got = {(r.id, r.phrase): r.n for r in phrases.counts(texts, known, most).collect()}
    lower = {p.lower() for p in PHRASES if p}
    assert got == {(i, p): n for i, t in enumerate(TEXTS) if t for p in lower if (n := plain(t, p))}


def test_counts_of_random_texts(spark):
    rng = random.Random(11)
    one = lambda n: "".join(rng.choice("ab. -") for _ in range(n))
    texts, known = [one(rng.randint(0, 60)) for _ in range(120)], list({one(rng.randint(1, 7)) for _ in range(150)})
    t, k = given(spark, texts, known)
    got = {(r.id, r.phrase): r.n for r in phrases.counts(t, k).collect()}
    assert got == {(i, p): n for i, x in enumerate(texts) for p in known if (n := plain(x, p))}


@pytest.mark.parametrize("most", [0, 2, 5, 5000])
def test_domains_do_not_depend_on_the_size_at_which_the_ontology_is_broadcast(spark, most):
    docs = spark.createDataFrame([(1, "Bitcoin hash rate of C++ code, bitcoin; the long and winding road"), (2, "a patient's heart rate")], "doc_id bigint, text string")
    onto = [("BTC", "bitcoin"), ("BTC", "hash rate"), ("X", "ether"), ("X", "proof of stake"), ("M", "heart rate"), ("R", "the long and winding road"), ("Y", "zzz"), ("Y", "c+")]
    got = sorted(tuple(r) for r in knowledge.domain_scores(docs, spark.createDataFrame(onto, "domain string, keyword string"), most_keywords=most).select("id", "domain", "score", "evidence", "rank").collect())
    assert got == [(1, "BTC", 1.0, "bitcoin: 2, hash rate: 1", 1), (1, "R", 0.333333, "the long and winding road: 1", 2), (2, "M", 1.0, "heart rate: 1", 1)]


def test_mentions_of_names_of_several_words(spark):
    chunks = spark.createDataFrame([("1:0", "The New York Times and Times New Roman"), ("1:1", "In New York, AT&T"), ("2:0", "new york city hall"), ("2:1", None)], "chunk_id string, text string")
    names = spark.createDataFrame([("e1", "New York"), ("e2", "New York Times"), ("e3", "Times"), ("e4", "AT&T"), ("e5", "New York City"), ("e6", "City Hall"), ("e7", "new york"), ("e8", None)], "id string, name string")
    want = {("1:0", "e2"), ("1:0", "e3"), ("1:1", "e1"), ("1:1", "e7"), ("1:1", "e4"), ("2:0", "e5"), ("2:0", "e6")}
    for most in (0, 5000):
        assert {tuple(r) for r in graph.build_mentions(chunks, names, most).collect()} == want


def test_a_few_phrases_meet_texts_in_batches_and_as_many_phrases_do(spark, monkeypatch):
    """No expression is built for each place of a text; marks at either end, batches that are cut and phrases without runs come out the same."""
    monkeypatch.setattr(phrases, "ROOM", 100)
    texts = [(i, t) for i, t in enumerate(["a b a b, c-d! a", "", None, "(a) a, b a b", "!! a !! b", "x", "a b" * 9, "c-d c-d!x a, b"] * 5)]
    d = spark.createDataFrame(texts, "id int, text string")
    p = spark.createDataFrame([(x,) for x in ["a", "a b", "A, b", "(a) ", "c-d!", "!! ", " a ", "b a b", "zz", "", None]], "phrase string")
    few, many = phrases.occurrences(d, p), phrases.occurrences(d, p, most=2)
    assert "MapInArrow" in few._jdf.queryExecution().toString()
    got = sorted(map(tuple, few.collect()))
    assert got == sorted(map(tuple, many.collect())) and len(got) > 50
