"""Licences that span lines or lie inside one, against brute force over all windows."""

import random
import textwrap

import pytest

from brindle.llm import licenses


def dice(window, template):
    a, b = set(window), set(licenses.bigrams_of(template))
    return 2 * len(a & b) / (len(a) + len(b))


def pairs(text):
    w = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return [f"{x} {y}" for x, y in zip(w, w[1:], strict=False)]


def best(text, template):
    p = pairs(text)
    n = len(pairs(template))
    return max((dice(p[i:j], template) for i in range(len(p)) for j in range(i + 1, min(len(p), i + 3 * n // 2) + 1)), default=0.0)


def test_passages(spark):
    t, rng = licenses.TEMPLATES, random.Random(3)
    prose = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    cut = t["GPL-3.0 (notice)"].replace("General ", "").replace("licensed under", "under")
    texts = [
        textwrap.fill(prose(90) + "\n", 80) + "\n" + textwrap.fill(t["MIT"], 80) + "\n" + textwrap.fill(prose(400), 80),
        textwrap.fill(prose(200) + " " + t["ISC"] + " " + prose(200), 80),
        prose(20) + " Released under the MIT License. " + prose(20),
        prose(9) + " " + cut + " " + prose(30),
        prose(30) + " under the terms of the licence, released by the MIT, see General Public " + prose(30),
        prose(40) + "\nReleased under the MIT License.\n" + prose(40),
        "", None, "licence",
    ]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in licenses.license_scan(d, passages=True).collect()}
    assert [got[i]["license"] for i in range(len(texts))] == ["MIT", "ISC", "MIT (notice)", None if best(texts[3], t["GPL-3.0 (notice)"]) < 0.8 else "GPL-3.0 (notice)", None, "MIT (notice)", None, None, None]
    assert [got[i]["n_units"] for i in (0, 1, 2, 4, 5)] == [1, 1, 1, 0, 1]
    assert not any(r["whole_text"] for r in got.values())
    for i in (2, 3):
        want = max(best(texts[i], v) for k, v in t.items() if k.endswith("(notice)"))
        assert got[i]["dice"] == pytest.approx(want if want >= 0.8 else 0.0)
    assert got[0]["dice"] == got[1]["dice"] == 1.0
    assert all(r["license"] is None for r in licenses.license_scan(d.where("doc_id < 5")).collect())


def test_alike_licences_are_one_unit_where_they_overlap(spark):
    t, rng = licenses.TEMPLATES, random.Random(5)
    prose = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    marked = lambda x: "\n".join("# " + y for y in textwrap.wrap(x, 76))
    names = ["GPL-3.0", "AGPL-3.0", "LGPL", "BSD-3-Clause", "Unlicense", "Zlib", "BSL-1.0", "CC-BY-SA-4.0 (notice)", "CC0-1.0 (notice)"]
    texts = [prose(50) + "\n" + marked(t[n]) + "\n" + prose(300) for n in names] + [prose(50) + "\n" + marked(t["MIT"]) + "\n" + prose(90) + "\n" + marked(t["GPL-3.0"])]
    got = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), passages=True).collect()}
    assert [got[i]["license"] for i in range(len(names))] == names
    assert [got[i]["n_units"] for i in range(len(texts))] == [1] * len(names) + [2]
    # a wrapped line may reach a notice by itself and is the unit then
    assert all(got[i]["dice"] == 1.0 for i in range(7)) and all(got[i]["dice"] >= 0.8 for i in (7, 8))


def test_odd_rows(spark):
    t = licenses.TEMPLATES
    line = "word " * 20_000 + t["MIT (notice)"] + " word" * 20_000
    rows = [(None, t["MIT"]), (None, t["MIT"]), (1, t["ISC"]), (1, t["ISC"]), (2, line), (3, None), (4, " \n\n "), (5, t["MIT (notice)"] + "\n" + t["Apache-2.0 (notice)"])]
    got = sorted(((r["doc_id"] or 0, r["license"] or "", r["n_units"], r["whole_text"]) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string"), passages=True).collect()))
    assert got == [(0, "MIT", 1, True)] * 2 + [(1, "ISC", 1, True)] * 2 + [(2, "MIT (notice)", 1, False), (3, "", 0, False), (4, "", 0, False), (5, "MIT (notice)", 2, False)]


def test_best_passages_of_random_texts(spark):
    """Few words, so that repeats, partial copies and near misses abound; every window of every text is tried."""
    rng = random.Random(9)
    templates = {"A": "a b c d e f g h i j k l", "B": "a b a c a d a e b c", "C": "x y"}
    texts = []
    for _ in range(60):
        words = []
        while len(words) < 60:
            t = rng.choice(list(templates.values())).split()
            cut = rng.randint(0, 3)
            words += [w if rng.random() > 0.12 else rng.choice("abcdxyz") for w in t[cut // 2 : len(t) - cut]] + [rng.choice("abcdefxyz") for _ in range(rng.randint(0, 6))]
        texts.append(" ".join(words))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for name, t in templates.items():
        got = {r["doc_id"]: r["dice"] for r in licenses.license_scan(d, templates={name: t}, passages=True).collect()}
        for i, text in enumerate(texts):
            want = best(text, t)
            assert got[i] == pytest.approx(want if want >= 0.8 else 0.0), (name, text)


def test_many_licences_in_one_text_take_seconds(spark):
    """500 wrapped copies with slips in one text cost a few seconds beyond one copy; 100 licensed files far less than a second a file."""
    import time

    rng, mit = random.Random(2), licenses.TEMPLATES["MIT"].split()
    slip = lambda: textwrap.fill(" ".join(w if rng.random() > 0.03 else "zz" for w in mit), 80)

    def took(texts):
        began = time.time()
        rows = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1), passages=True).collect()
        assert all(r["license"] == "MIT" for r in rows)
        return time.time() - began

    took([slip()])
    one = took([slip()])
    assert took(["\n\n".join(slip() for _ in range(500))]) < one + 20
    assert took([slip() for _ in range(100)]) < one + 10


def test_templates_of_a_folder(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("You may do with this text whatever you like as long as you tell nobody about it.")
    (tmp_path / "Other").write_text("No one may do anything with this text at all, at any time or place.")
    own = licenses.load_templates(spark, str(tmp_path))
    assert list(own) == ["Other", "Own-1.0"]
    d = spark.createDataFrame([(1, "x y z " + own["Own-1.0"].upper() + " q r s"), (2, own["Other"]), (3, licenses.TEMPLATES["MIT"])], "doc_id bigint, text string")
    assert {r["doc_id"]: r["license"] for r in licenses.license_scan(d, templates=own, passages=True).collect()} == {1: "Own-1.0", 2: "Other", 3: None}
