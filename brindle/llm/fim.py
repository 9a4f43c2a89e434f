"""Fill-in-middle texts by escaped marker injection, with SQL functions only.

A delimiter is injected behind every unit of the text, so that places in units
become places that ``substring_index`` finds: the text's own delimiters are
escaped, ``regexp_replace`` appends the delimiter after each unit, the
delimiters are counted, the parts before and between two ranks are extracted
and what was escaped is put back. No array of units is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import let, text_of

#: Neither is white space, so escaping leaves the units as they are.
DELIMITER, ESCAPE = "\x01", "\x02"
#: White space and the word after it, or white space at the end.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"


def escaped(c: Column) -> Column:
    """The text without ``DELIMITER``; afterwards every ``ESCAPE`` is followed by e or d."""
    return F.replace(F.replace(c, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(DELIMITER), F.lit(ESCAPE + "d"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(ESCAPE + "d"), F.lit(DELIMITER)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def marked(text: Column) -> Column:
    """The escaped text with the delimiter after each unit."""
    return F.regexp_replace(escaped(text), UNIT, "$0" + DELIMITER)


def _index(c: Column, delimiter: str | Column, count: int | Column) -> Column:
    return F.call_function("substring_index", c, *(x if isinstance(x, Column) else F.lit(x) for x in (delimiter, count)))


def before(c: Column, rank: Column) -> Column:
    """The units up to rank, delimiters included but the last."""
    return _index(c, DELIMITER, rank.cast("int"))


def after(c: Column, n: Column, rank: Column) -> Column:
    """The units behind rank."""
    return _index(c, DELIMITER, (rank - n - 1).cast("int"))


def joined(part: Column) -> Column:
    """A part of the marked text as it was in the text."""
    return unescaped(F.replace(part, F.lit(DELIMITER), F.lit("")))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The exact text, from the output and its form alone."""
    p, s, m = markers
    cut = lambda start, end: _index(_index(output, start, -1), end, 1)
    psm = F.concat(cut(p, s), _index(output, m, -1), cut(s, m))
    spm = F.concat(cut(p, m), _index(output, m, -1), cut(s, p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, percent: int = 50, spm: int = 80, markers: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> DataFrame:
    """One row per input row: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    ``n`` counts the units of the whole text. The cuts, and whether and how a
    text is changed, follow from the hash of seed and id, so a repeated task
    gives the same rows. ``percent`` of the texts are changed, ``spm`` of these
    a hundred to suffix-prefix-middle, the others to prefix-suffix-middle. A text
    that is empty or holds a marker stays plain, and ``restored`` gives every
    text back. Null texts are empty ones; a null id counts as an empty one, so
    repeated ids are cut alike. An empty table gives an empty result; other
    columns are ignored. Markers begin with a character that none of
    them holds elsewhere, as in ``<P>``.
    """
    if any(not m or m[0] in b[1:] for m in markers for b in markers) or len(set(markers)) < 3:
        raise ValueError("markers must differ and begin with a character that they hold nowhere else")
    p, s, m = map(F.lit, markers)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("bigint").cast("string"), F.lit(""))), 256)
    h = lambda k: F.conv(F.substring("_digest", 8 * k - 7, 8), 16, 10).cast("bigint")
    base = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text_of(docs, text_col).alias("_text"), digest.alias("_digest"))
    plain = (F.col("_text") == "") | F.contains("_text", p) | F.contains("_text", s) | F.contains("_text", m) | (h(3) % 100 >= percent)
    form = F.when(plain, "plain").when(h(4) % 100 < spm, "spm").otherwise("psm")

    def cut(t: Column) -> Column:
        """n and the three parts, the marked text computed once."""
        n = F.length(t) - F.length(F.replace(t, F.lit(DELIMITER), F.lit("")))

        def at(x: Column) -> Column:
            low, high = F.least(x.a, x.b), F.greatest(x.a, x.b)
            middle = F.when(low == high, "").otherwise(_index(before(t, high), DELIMITER, (low - high).cast("int")))
            return F.struct(x.n.alias("n"), joined(before(t, low)).alias("prefix"), joined(middle).alias("middle"), joined(after(t, x.n, high)).alias("suffix"))

        return let(n.cast("bigint"), lambda k: let(F.struct(k.alias("n"), (h(1) % (k + 1)).alias("a"), (h(2) % (k + 1)).alias("b")), at))

    rows = base.select("doc_id", "_text", form.alias("form"), let(marked(F.col("_text")), cut).alias("_cut"))
    x, changed = F.col("_cut"), F.col("form") != "plain"
    output = F.when(~changed, F.col("_text")).when(F.col("form") == "psm", F.concat(p, x.prefix, s, x.suffix, m, x.middle)).otherwise(F.concat(s, x.suffix, p, x.prefix, m, x.middle))
    return rows.select(
        "doc_id",
        x.n.alias("n"),
        "form",
        F.when(changed, F.length(x.prefix)).cast("bigint").alias("prefix_chars"),
        F.when(changed, F.length(x.middle)).cast("bigint").alias("middle_chars"),
        output.alias("output"),
    )
