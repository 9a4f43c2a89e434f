"""Rules, classifier, licences and page extraction."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import html_main, licenses, quality_model, quality_rules
from brindle.llm import queries
from tests.llm.fixtures import documents, empty
from tests.oracle import both


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, r = len(w), len(hit)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), r, n < 10 or 100 * r > 20 * n


def test_base_counts_match_brute_force(spark):
    d, rows = documents(spark)
    extra = [(900, "a b c d e x a b c d e y", "en"), (901, "q q q q q q q", "en"), (902, "x\nx\n \ny#$\nx\r\n", None), (903, "a\x0bb \x0c c|<", "en")]
    more = spark.createDataFrame([(i, t, g, "s", 1, True, "z", "y", 0.5, 7) for i, t, g in extra], d.schema)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (None, 1)], "doc_id bigint, quality int")
    got = quality_rules.quality_rules(d.union(more), labels)
    want = Counter((i, *base(t)) for i, t in [(r[0], r[1]) for r in rows] + [(i, t) for i, t, _ in extra])
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == want
    # so few labels prove nothing: the base rules alone decide
    assert got.where("kept = base_failed").count() == 0
    assert quality_rules.quality_rules(empty(spark), labels).count() == 0


@pytest.mark.parametrize("n,k,p", [(100, 0, 0.01), (2000, 3, 0.006), (5000, 20, 0.006), (10, 0, 0.5), (400, 30, 0.1)])
def test_binomial_tail_is_exact(spark, n, k, p):
    want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    got = spark.range(1).select(quality_rules._p_value(F.lit(n).cast("bigint"), F.lit(k).cast("bigint"), p)).first()[0]
    assert got == pytest.approx(want, rel=1e-9)


def test_cutoffs_hold_their_risk(spark):
    """Bad documents have symbols, good ones do not: the cutoff rejects the bad and only a proven share of the good."""
    rows = [(i, "plain words " * 8 if i % 5 else "sym #### bols " * 8, "en" if i % 2 else "xx", int(i % 5 > 0)) for i in range(9000)]
    d = spark.createDataFrame([(i, t.replace("words", f"w{i} x{i * 7} y{i * 3}").replace("bols", f"b{i} c{i * 5}"), g) for i, t, g, _ in rows], "doc_id bigint, text string, lang string")
    d = d.withColumn("text", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: F.concat(F.when(F.col("text").contains("#"), "##").otherwise(""), F.lit("v"), F.hex(F.xxhash64("doc_id", k))))))
    labels = spark.createDataFrame([(i, q) for i, _, _, q in rows], "doc_id bigint, quality int")
    got = quality_rules.quality_rules(d, labels).join(labels, "doc_id")
    assert got.where("quality = 1 and not kept").count() <= 0.03 * 7200
    assert got.where("quality = 0 and kept").count() == 0
    few = quality_rules.quality_rules(d, labels.where("doc_id < 300"))
    assert few.where("not kept").count() == 0


def test_every_stratum_has_its_own_cutoff(spark):
    """400 strata, in each of which another share of good documents has symbols; cutoffs by hand for each."""
    rows = []
    for g in range(400):
        for i in range(40):
            good = i < 30
            symbols = i % 3 if good and g % 2 else 0 if good else 9
            rows.append((g * 1000 + i, " ".join(f"w{g}x{i}y{k}" for k in range(12)) + " #" * symbols, f"s{g}", int(good)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, quality int")
    # a share of 0.5 for each of five rules, so that 30 good documents prove something
    kw = {"alpha": 2.5, "delta": 0.9, "cost": 0.5}
    got = {n: {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(d.drop("quality"), d.select("doc_id", "quality"), broadcast_strata=n, **kw).collect()} for n in (10_000, 0)}
    assert got[0] == got[10_000]
    assert all(got[0][r[0]] == bool(r[3]) for r in rows if r[0] // 1000 % 2 == 0)
    assert sum(not got[0][r[0]] for r in rows if not r[3]) == 4000


def test_learned_rules_match_their_sql(spark):
    """At sf0.1 there are labels enough for learned rules; counts by SQL."""
    sf = "/root/testdata/sf0.1"
    ours, theirs = both(spark, queries.QUERIES["op3_quality_rules"], queries.ORACLES["op3_quality_rules"], sf)
    assert ours == theirs and sum(bool(r[-1]) for r in ours) > 100


def test_trees_learn_and_are_deterministic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    a, b = quality_model.fit(x[:1000], y[:1000]), quality_model.fit(x[:1000], y[:1000])
    assert ((a.score(x[1000:]) >= 0.5) == y[1000:]).mean() > 0.95
    assert np.array_equal(a.score(x), b.score(x))

    def slow(t, row):
        out = t.base
        for f, c, leaf in zip(t.feature, t.cut, t.leaf, strict=True):
            i = 0
            while i < len(f):
                i = 2 * i + 1 + (row[f[i]] > c[i])
            out += leaf[i - len(f)]
        return out

    assert np.allclose([slow(a, r) for r in x[:50]], a.margin(x[:50]))
    assert quality_model.fit(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3
    assert len(set(quality_model.fit(x[:9], np.ones(9)).score(x).tolist())) == 1


def slow_tree(x, y, margin, depth, rate, bins, l2, least):
    """One tree by trying every cut of every statistic, and the new margins."""
    p = 1 / (1 + np.exp(-margin))
    g, h = p - y, p * (1 - p)
    edges = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower").tolist())) for j in range(x.shape[1])]
    out = np.zeros(len(y))

    def grow(rows, left):
        if not left:
            out[rows] = -rate * g[rows].sum() / (h[rows].sum() + l2)
            return
        best, found = 1e-9, None
        for j, cuts in enumerate(edges):
            for c in cuts:
                a, b = rows[x[rows, j] <= c], rows[x[rows, j] > c]
                if h[a].sum() < least or h[b].sum() < least:
                    continue
                gain = sum(g[r].sum() ** 2 / (h[r].sum() + l2) for r in (a, b)) - g[rows].sum() ** 2 / (h[rows].sum() + l2)
                if gain > best + 1e-12:
                    best, found = gain, (a, b)
        if found is None:
            out[rows] = -rate * g[rows].sum() / (h[rows].sum() + l2)
            return
        for r in found:
            grow(r, left - 1)

    grow(np.arange(len(y)), depth)
    return margin + out


def test_trees_match_trying_every_cut():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(240, 4)).round(1)
    y = ((x[:, 0] + 0.5 * x[:, 2] > 0) ^ (rng.random(240) < 0.1)).astype(float)
    kw = {"depth": 3, "rate": 0.3, "bins": 16, "l2": 1.0, "least": 3.0}
    prior = (y.sum() + 1) / (len(y) + 2)
    margin = np.full(len(y), np.log(prior / (1 - prior)))
    for n in range(1, 5):
        margin = slow_tree(x, y, margin, **kw)
        assert np.allclose(quality_model.fit(x, y, trees=n, **kw).margin(x), margin)


def test_statistics_by_hand():
    text = "The cat sat, the cat!\nAB 12\nAB 12\n"
    s = dict(zip(quality_model.FEATURES, quality_model.statistics(text), strict=True))
    words = text.split()
    want = {
        "log_bytes": math.log1p(len(text)), "log_words": math.log1p(len(words)), "mean_word": sum(map(len, words)) / len(words), "upper": sum(c.isupper() for c in text) / len(text), "digits": 4 / len(text), "commas": 1 / len(words), "bangs": 1 / len(words),
        "distinct_words": len(set(words)) / len(words), "top_word": 2 / len(words), "dup_lines": 1 / 3, "upper_words": 2 / len(words), "title_words": 1 / len(words), "ascii_words": 1.0, "short_words": sum(len(w) <= 3 for w in words) / len(words),
    }
    assert {k: pytest.approx(v) for k, v in want.items()} == {k: s[k] for k in want}
    assert quality_model.statistics("") == quality_model.statistics(" \n\t") == [0.0] * len(quality_model.FEATURES)


def test_equal_texts_have_equal_scores(spark):
    d = spark.createDataFrame([(i, ["some words of text here", "other # text"][i % 2]) for i in range(40)], "doc_id bigint, text string").repartition(7)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id bigint, quality int")
    got = quality_model.quality_scores(d, labels).collect()
    assert len({r["score"] for r in got if r["doc_id"] % 2}) == 1 and len({r["score"] for r in got}) == 2


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    got = quality_model.quality_scores(docs, labels).join(labels, "doc_id").where("held_out")
    assert got.where("predicted = quality").count() >= 0.93 * got.count()


def test_scores_of_odd_rows(spark):
    d, rows = documents(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 0), (None, 1), (4, 7)], "doc_id bigint, quality int")
    got = quality_model.quality_scores(d, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    blank = [r[0] for r in rows if not (r[1] or "").strip()]
    assert len({by[i] for i in blank}) == 1
    none = quality_model.quality_scores(d, labels.where("false")).select("score").distinct().collect()
    assert [r[0] for r in none] == [0.5]
    assert quality_model.quality_scores(empty(spark), labels).count() == 0
    kept = quality_model.accept(d, labels)
    assert kept.columns == d.columns and kept.count() == sum(r["score"] >= 0.3 for r in got)


def dice(text, template):
    a, b = (set(licenses.bigrams_of(x)) for x in (text, template))
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def test_license_scan_matches_brute_force(spark):
    t = licenses.TEMPLATES
    texts = [
        t["MIT"], t["MIT"].upper().replace(",", " ;"), "Copyright 2020 me\n" + t["MIT"], "prose here\nReleased under the MIT License.\nmore prose", "Released under the MIT License", "Licensed under CC BY-NC 4.0.", "licence", "", None,
        "x\nThis work is licensed under the GNU General Public License, version 3.\nLicensed under the Apache License, Version 2.0.", t["Apache-2.0"][:300], "word " * 5000,
    ]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("license", F.lit("x")).withColumn("dice", F.lit(1))
    got = {r["doc_id"]: r for r in licenses.license_scan(d).collect()}
    for i, text in enumerate(texts):
        units = [text or "", *((text or "").split("\n") if "\n" in (text or "") else [])]
        best = [max((round(dice(u, v), 12), k) for k, v in t.items()) for u in units]
        found = [x for x in best if x[0] >= 0.8]
        assert got[i]["n_units"] == len(found)
        assert (got[i]["license"], round(got[i]["dice"], 12)) == ((max(found)[1], max(found)[0]) if found else (None, 0.0))
        assert got[i]["whole_text"] == (best[0][0] >= 0.8)
    assert licenses.license_scan(empty(spark)).count() == 0


PAGES = [
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><article><h1>Head&amp;</h1><p>First  para<br>line.<p>Second <b>bold</b>.</article><footer>foot</footer></body></html>", "Head&\nFirst para line.\nSecond bold ."),
    ("<body><header><h1>Site</h1></header><main><h2>A</h2><p>Some text that is long enough to count as text.</p><form><p>Your mail</p></form><div class='ad'>Buy!</div><aside>More</aside></main><div id=comments><article><p>I disagree with everything said above here.</p></article></div></body>", "A\nSome text that is long enough to count as text."),
    ("<div class=nav-menu><a>x</a></div><div class=post><p>" + "body text " * 20 + "<p>Short.<p>" + "more text " * 20 + "</div><div class='cookie-notice'>We use cookies</div>", ("body text " * 20).strip() + "\nShort.\n" + ("more text " * 20).strip()),
    ("<script>var t='</p><p>no</p>';</script><p>yes &lt;ok&gt; &#233;&nbsp;x", "yes <ok> é x"),
    ("", ""), (None, ""), ("<nav>only</nav>", ""), ("plain", "plain"),
]


@pytest.mark.parametrize("html,want", PAGES)
def test_main_text(html, want):
    assert html_main.main_text(html).replace(" .", ".") == want.replace(" .", ".")


def test_pages_of_the_given_tables(spark):
    import html as h

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in html_main.extract_main_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        body = r["html"].split("<article>")[1].split("</article>")[0].split("<footer>")[0]
        parts = [" ".join(h.unescape(re.sub("<[a-z/][^>]*>", " ", x)).split()) for x in re.split("</?p>|</?h1>", body)]
        assert r["text"] == "\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"])


def plain_pages(pages):
    """The given pages with every mark of structure taken away: nothing but divisions."""
    return [re.sub("</(article|nav|footer)>", "</div>", re.sub('<article>|<nav>|<div class="ad">|<footer>', "<div>", x)) for x in pages]


def test_the_ratio_decides_where_no_name_does(spark):
    """Without article, nav, footer and class names the text is still found, and not without the ratio. A short sentence, such as these pages' adverts, looks like text then."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    want = [html_main.main_text(r["html"]) for r in rows]
    pages = plain_pages([r["html"] for r in rows])
    got, off = [html_main.main_text(x) for x in pages], [html_main.main_text(x, by_ratio=False) for x in pages]
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.35 * len(rows)
    assert all(set(b.split("\n")) <= set(a.split("\n")) and a.count("\n") <= b.count("\n") + 2 for a, b in zip(got, want, strict=True))
    assert sum(a == b for a, b in zip(off, want, strict=True)) <= 0.05 * len(rows)
    no_article = [re.sub("</?article>", "", r["html"]) for r in rows]
    assert [html_main.main_text(x) for x in no_article] == want


LONG = "<p>" + "words of the text that is meant " * 12


@pytest.mark.parametrize(
    "html,want",
    [
        ("<article>" + LONG * 3 + "</article><article class=teaser><h2>Other</h2><p>A short teaser.</article>", 3),
        ("<article>" + LONG + "</article><article>" + LONG + "</article><article>" + LONG + "</article>", 3),
        ("<p><a href=x>link" + LONG * 2, 2),
        ("<div><a href=x>link<a href=y>other</div>" + LONG * 2, 2),
        ("<div class=sidebar>" + LONG * 2 + "</div>", 2),
        ("<nav>" + LONG * 2 + "</nav>", 2),
        ("<div class='comment-free promo-story'>" + LONG * 2 + "</div>", 2),
        ("<div id=content-notice-board>" + LONG * 2 + "</div>", 2),
        ("<div>" + LONG * 2 + "</div><ul>" + "<li><a href=x>More like this</a>" * 6 + "</ul>", 2),
    ],
)
def test_a_prior_is_no_more(html, want):
    line = " ".join(LONG[3:].split())
    assert html_main.main_text(f"<body>{html}</body>") == "\n".join([line] * want)


HEAD, END = "<h1><a href=x>The headline</a></h1>", "<p><a href=y>Read the whole report</a></p>"


@pytest.mark.parametrize(
    "html,want",
    [
        ("<article>" + HEAD + LONG + END + "</article>", ["The headline", 1, "Read the whole report"]),
        ("<article>" + HEAD + LONG + "<p><a href=x>A link between</a>" + LONG + "</article>", ["The headline", 1, "A link between", 1]),
        ("<article>" + LONG + "<ul><li><a href=x>First source</a><li><a href=y>Second source</a></ul></article>", [1, "First source", "Second source"]),
        ("<div>" + HEAD + LONG + LONG + END + "</div>", ["The headline", 2, "Read the whole report"]),
        ("<div>" + LONG + LONG + "<p><a href=x>One</a> | <a href=y>Two</a></div>", [2]),
        ("<article><h1>Short</h1><p>An article of one sentence, no longer than this.</article><div>" + LONG * 6 + "</div>", ["Short", "An article of one sentence, no longer than this."]),
        ("<div>" + LONG * 6 + "</div><article><p>An article of one sentence, no longer than this.</article>", ["An article of one sentence, no longer than this."]),
        ("<article><p>Short.</article><div>" + LONG * 6 + "</div>", [6]),
        ("<div>" + LONG * 2 + "</div><div class=side-bar>" + LONG + "</div><div id=SideBar>" + LONG + "</div>", [2]),
    ],
)
def test_links_and_short_articles_are_not_lost(html, want):
    line = " ".join(LONG[3:].split())
    assert html_main.main_text(f"<body>{html}</body>") == "\n".join(x for w in want for x in ([line] * w if isinstance(w, int) else [w]))


@pytest.mark.parametrize("html", ["<!-- " * 20000, "<div><p>x" * 2000, "<div>" * 5000 + "x" + "</div>" * 5000, "<p>a</b>" * 20000, "<" * 50000, '<a href="' * 20000, "&#" * 50000, "<article class=x>" * 3000 + "y"])
def test_hostile_pages_take_time_in_proportion(html):
    import time

    began = time.time()
    html_main.main_text(html)
    assert time.time() - began < 2


def test_very_long_pages_are_whole():
    line = "word " * 200_000
    assert html_main.main_text(f"<body><div><p>{line}<p>{line}</div><p>x &lt;") == f"{line.strip()}\n{line.strip()}"


def test_pages_with_odd_rows(spark):
    d = spark.createDataFrame([(1, None, "<p>a</p>", "t", 5), (1, None, "<p>a</p>", "t", 5), (None, "u", None, "t", 5)], "page_id bigint, url string, html string, text string, n_chars int")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_main.extract_main_text(d).collect()) == [(0, "", 0), (1, "a", 1), (1, "a", 1)]
    assert html_main.extract_main_text(d.where("false")).count() == 0
