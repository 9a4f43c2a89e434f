r"""Many phrases in many texts, each as ``\b`` phrase ``\b`` finds it in the lower-cased text, by equality alone.

A lower-cased text is a row of units: runs of word characters (letters, digits,
underscore) and the gaps between them. A phrase with borders at both ends covers
whole units: its runs are runs of the text, its inner gaps are the text's, and
marks at its ends are the whole of a gap between two runs. So a phrase of m runs,
with or without marks at its ends, is one of the text's spans of that shape, and
spans meet phrases by an equi-join, without a regular expression for each phrase.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from brindle.shared import small_batches

#: Word characters as Python's ``\w`` has them.
WORD = r"\p{L}\p{N}_"
#: Bytes of runs and gaps that are met at once.
ROOM = 4_000_000


def _shaped(phrases: DataFrame, column: str) -> DataFrame:
    """``phrase, runs, lead, trail``: distinct lower-case phrases with their number of runs and whether marks begin and end them."""
    low = phrases.select(F.lower(column).alias("phrase")).where("phrase != ''").distinct()
    marks = lambda at: F.col("phrase").rlike(at).cast("int")
    return low.select("phrase", F.size(F.regexp_extract_all("phrase", F.lit(f"[{WORD}]+"), F.lit(0))).alias("runs"), marks(rf"\A[^{WORD}]").alias("lead"), marks(rf"[^{WORD}]\z").alias("trail"))


def _met(phrases: list[Row]) -> Callable:
    """Batches of ``id, r, g`` to ``id, phrase, first, last``, for phrases with runs, by walking all their places through a table of each shape."""
    runs, gaps = (pa.array(sorted({x for p in phrases for x in p[c]}), pa.string()) for c in ("r", "g"))
    number = [{x: i for i, x in enumerate(v.to_pylist())} for v in (runs, gaps)]
    wide = max(len(runs), len(gaps)) + 1
    shapes = []
    for shape in sorted({(p.runs, p.lead, p.trail) for p in phrases}):
        own = [p for p in phrases if (p.runs, p.lead, p.trail) == shape]
        m, lead, trail = shape
        # what is compared, run by run, with the gaps before and after each
        steps = [(0, 0)] + [(1, 0)] * lead + [x for k in range(1, m) for x in ((1, k), (0, k))] + [(1, m)] * trail
        state, levels = np.zeros(len(own), np.int64), []
        for kind, k in steps:
            level, state = np.unique(state * wide + np.array([number[kind][p["g" if kind else "r"][k]] for p in own]), return_inverse=True)
            levels.append(level)
        names = np.empty(len(own), object)
        names[state] = [p.phrase for p in own]
        shapes.append((m, lead, trail, list(zip(steps, levels)), names))

    def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
        r, g, ids = (pa.concat_arrays(t.column(c).chunks) for c in ("r", "g", "id"))
        n, many = (pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (r, g))
        code = [pc.fill_null(pc.index_in(x.flatten(), v), -1).to_numpy(zero_copy_only=False).astype(np.int64) for x, v in ((r, runs), (g, gaps))]
        of, starts = np.repeat(np.arange(len(n)), n), [np.cumsum(n) - n, np.cumsum(many) - many]
        place = np.arange(len(of)) - starts[0][of]
        for m, lead, trail, levels, names in shapes:
            at = np.flatnonzero((code[0] >= 0) & (place >= lead) & (place <= n[of] - m - trail))
            state = np.zeros(len(at), np.int64)
            for (kind, k), level in levels:
                c = code[kind][starts[kind][of[at]] + place[at] + k]
                key = state * wide + c
                state = np.minimum(np.searchsorted(level, key), len(level) - 1)
                ok = (level[state] == key) & (c >= 0)
                at, state = at[ok], state[ok]
            i = place[at]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(of[at])), pa.array(names[state], pa.string()), pa.array((2 * i + 1 - lead).astype(np.int32)), pa.array((2 * (i + m) - 1 + trail).astype(np.int32))], ["id", "phrase", "first", "last"])

    def run(batches):
        held, room = [], 0
        for b in batches:
            held.append(b)
            room += b.nbytes
            if room > ROOM:
                yield from found(pa.Table.from_batches(held))
                held, room = [], 0
        if held:
            yield from found(pa.Table.from_batches(held))

    return run


def occurrences(texts: DataFrame, phrases: DataFrame, most: int = 5_000, id_col: str = "id", text_col: str = "text", phrase_col: str = "phrase") -> DataFrame:
    """``id, phrase, first, last``: every occurrence, overlapping ones too, with its first and last unit.

    Phrases come back in lower case, each once. Up to ``most`` distinct phrases go
    to the tasks, which meet them where a text is read; beyond that, spans and
    phrases are shuffled. Null texts hold nothing; null and empty phrases are left out.
    """
    shaped = _shaped(phrases, phrase_col)
    cut = lambda c: (F.regexp_extract_all(c, F.lit(f"[{WORD}]+"), F.lit(0)).alias("r"), F.split(c, f"[{WORD}]+", -1).alias("g"))
    known = shaped.select("*", *cut(F.col("phrase"))).limit(most + 1).collect()
    few = len(known) <= most
    # distinct numbers of runs: n of them need n (n + 1) / 2 runs, so there are few
    shapes = sorted({(p.runs, p.lead, p.trail) for p in known} if few else {tuple(r) for r in shaped.select("runs", "lead", "trail").distinct().collect()})

    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    d = texts.select(F.col(id_col).alias("id"), *cut(low))
    r, g, n = F.col("r"), F.col("g"), F.size("r")
    none = F.array().cast("array<struct<phrase:string,first:int,last:int>>")

    def spans(runs: int, lead: int, trail: int) -> Column:
        if not runs:
            at = F.sequence(F.lit(1), n - 1)
            return F.when(n >= 2, F.transform(at, lambda i: F.struct(F.get(g, i).alias("phrase"), (2 * i).alias("first"), (2 * i).alias("last")))).otherwise(none)

        def one(i: Column) -> Column:
            inner = [F.get(r, i)] + [x for k in range(1, runs) for x in (F.get(g, i + k), F.get(r, i + k))] if runs <= 4 else [F.get(r, i), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(runs - 1)), lambda k: F.concat(F.get(g, i + k), F.get(r, i + k))), "")]
            text = F.concat(*([F.get(g, i)] if lead else []), *inner, *([F.get(g, i + runs)] if trail else []))
            return F.struct(text.alias("phrase"), (2 * i + 1 - lead).alias("first"), (2 * (i + runs) - 1 + trail).alias("last"))

        low_, high = F.lit(lead), n - runs - trail
        at = F.sequence(low_, high)
        return F.when(high >= low_, F.transform(at, one)).otherwise(none)

    built = [s for s in shapes if not (few and s[0])]
    found = d.select("id", F.inline(F.concat(*(spans(*s) for s in built)) if built else none))
    wanted = shaped.select("phrase")
    found = found.join(F.broadcast(wanted) if few else wanted, "phrase").select("id", "phrase", "first", "last")
    if few and any(p.runs for p in known):
        small_batches(texts.sparkSession)
        met = d.mapInArrow(_met([p for p in known if p.runs]), f"id {d.schema['id'].dataType.simpleString()}, phrase string, first int, last int")
        found = found.union(met) if built else met
    return found


def counts(texts: DataFrame, phrases: DataFrame, most: int = 5_000, id_col: str = "id", text_col: str = "text", phrase_col: str = "phrase") -> DataFrame:
    """``id, phrase, n``: how often each text holds each phrase, from left to right and without overlaps of one phrase with itself."""
    found = occurrences(texts, phrases, most, id_col, text_col, phrase_col)
    units = F.regexp_extract_all("phrase", F.lit(f"[{WORD}]+|[^{WORD}]+"), F.lit(0))
    itself = F.transform(F.array(units), lambda u: F.when(F.size(u) > 1, F.exists(F.sequence(F.lit(1), F.size(u) - 1), lambda s: F.slice(u, s + 1, F.size(u) - s) == F.slice(u, F.lit(1), F.size(u) - s))).otherwise(F.lit(False)))[0]
    # only phrases that can overlap themselves have their places gathered, those of one text
    g = found.groupBy("id", "phrase").agg(F.count(F.lit(1)).alias("all"), F.array_sort(F.collect_list(F.when(itself, F.struct("first", "last")))).alias("places"))
    apart = F.aggregate(
        "places",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).alias("end")),
        lambda s, x: F.when(x["first"] > s["end"], F.struct((s["n"] + 1).alias("n"), x["last"].alias("end"))).otherwise(s),
        lambda s: s["n"],
    )
    return g.select("id", "phrase", F.when(F.size("places") > 0, apart).otherwise(F.col("all")).alias("n"))


def longest(found: DataFrame) -> DataFrame:
    """Of ``occurrences`` those that lie inside no longer one of their text."""
    w = Window.partitionBy("id").orderBy("first", F.desc("last")).rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("_end", F.max("last").over(w)).where("_end is null or last > _end").drop("_end")
