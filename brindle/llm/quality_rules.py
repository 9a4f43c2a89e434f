"""Quality rules with risk-controlled thresholds, with DataFrame functions only.

Base rules are fixed. The learned rules reject a document when an integer level
(symbols, repeats, repeated lines, long or short words) reaches its stratum's
cutoff. A cutoff may be used only if the labelled good documents prove, by an
exact binomial test, that it rejects less than ``alpha / number of rules`` of
the stratum's good documents. Cutoffs of one rule are tested from the mildest
on, stopping at the first that fails (fixed-sequence testing, so their number
costs nothing); rules and strata share ``delta`` by Bonferroni's correction.
With probability ``1 - delta`` no stratum's false rejections exceed ``alpha``.
Of the proven cutoffs the one with the most rejected bad documents, less
``cost`` times the rejected good ones, is taken; a rule without one is idle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import SPACES, Written, let, text_of

#: Largest level of each rule; a level is an integer from 0 to this.
RULES = {"symbols": 1000, "repeats": 100, "dup_lines": 100, "long_words": 400, "short_words": 400}


def _repeat_words(words: Column) -> Column:
    """Words inside a five-word window that the text holds at least twice."""

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.when(k == 0, F.lit(5)).otherwise(F.least(F.lit(5), x - F.get(p, k - 1))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def exact(starts: Column) -> Column:
        grams = F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", F.slice(words, i, 5)).alias("g"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            hit = F.filter(s, lambda x, k: (F.get(s, k - 1)["g"] == x["g"]) | (F.get(s, k + 1)["g"] == x["g"]))
            return let(F.sort_array(F.transform(hit, lambda x: x["i"])), covered)

        return let(grams, repeated)

    def by_hash(starts: Column) -> Column:
        # equal windows have equal hashes, so a text without equal hashes has no repeat
        hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(-1, 4))))
        return F.when(let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h)), exact(starts)).otherwise(F.lit(0))

    return F.when(F.size(words) < 6, F.lit(0)).otherwise(let(F.sequence(F.lit(1), F.size(words) - 4), by_hash))


def signals(text: Column) -> Column:
    """A struct of the base counts of one text (not null)."""
    words = F.filter(F.split(text, SPACES + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), _repeat_words(w).cast("bigint").alias("n_repeat_words")))
    lined = let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    return F.struct(
        counted.alias("w"),
        lined.alias("l"),
        F.length(F.regexp_replace(text, SPACES + "+", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
    )


def _levels(d: DataFrame) -> Column:
    per = lambda name, scale, by: F.expr(f"coalesce({scale} * {name} div nullif({by}, 0), 0)")
    length = per("word_chars", 20, "n_words")
    made = {"symbols": per("n_symbols", 100, "n_words"), "repeats": per("n_repeat_words", 100, "n_words"), "dup_lines": per("n_dup_lines", 100, "n_lines"), "long_words": length, "short_words": RULES["short_words"] - length}
    return F.array(*(F.struct(F.lit(k).alias("rule"), F.greatest(F.lit(0), F.least(F.lit(RULES[k]), made[k])).cast("int").alias("level")) for k in RULES))


def _p_value(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X binomial of n and p, for k < n p: the largest term times the sum of all against it."""
    i = F.sequence(F.lit(1).cast("bigint"), k)
    log_choose = F.aggregate(i, F.lit(0.0), lambda a, x: a + F.log((n - x + 1) / x))
    # Horner from the first term on: s <- 1 + s * term(i-1) / term(i)
    total = F.aggregate(i, F.lit(1.0), lambda a, x: F.lit(1.0) + a * (x * (1 - p)) / ((n - x + 1) * p))
    first = n * F.log(F.lit(1 - p))
    return F.when(k == 0, F.exp(first)).otherwise(F.exp(log_choose + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)) + F.log(total)))


def cutoffs(labelled: DataFrame, alpha: float, delta: float, cost: float) -> DataFrame:
    """From ``stratum, good, levels`` rows: ``stratum, rule, cutoff`` of each rule that has a proven cutoff."""
    share = alpha / len(RULES)
    counts = labelled.select("stratum", "good", F.explode("levels").alias("x")).groupBy("stratum", F.col("x.rule").alias("rule"), F.col("x.level").alias("level"))
    counts = counts.agg(F.sum(F.col("good").cast("bigint")).alias("g"), F.sum((~F.col("good")).cast("bigint")).alias("b"))
    down = Window.partitionBy("stratum", "rule").orderBy(F.desc("level"))
    tails = counts.select("stratum", "rule", "level", F.sum("g").over(down).alias("k"), F.sum("b").over(down).alias("caught"), F.sum("g").over(Window.partitionBy("stratum", "rule")).alias("n"))
    # tests: one for each rule of each stratum
    tests = max(1, counts.select("stratum", "rule").distinct().count())
    able = tails.where((F.col("n") > 0) & (F.col("k") < F.col("n") * share))
    proven = able.where(_p_value(F.col("n"), F.col("k"), share) <= delta / tests)
    gain = F.col("caught") - cost * F.col("k")
    return proven.where(gain > 0).groupBy("stratum", "rule").agg(F.max(F.struct(gain.alias("gain"), F.col("level").alias("cutoff"))).alias("x")).select("stratum", "rule", "x.cutoff")


def quality_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = 0.03, delta: float = 0.05, cost: float = 4.0, broadcast_strata: int = 10_000, salts: int = 16
) -> DataFrame:
    """One row per input row: the base counts, ``base_failed``, ``kept`` and the failed learned rules in ``rules_failed``.

    ``labels`` has ``doc_id, quality``; quality 1 is good and 0 bad, other
    values and null are unlabelled, and an id that is labelled both ways counts
    as good. Null text is empty (no words: base_failed), a null stratum is a
    stratum of its own. Every stratum has cutoffs of its own. Their table is
    counted: up to ``broadcast_strata`` rows are broadcast, more are joined, each
    stratum spread over ``salts`` keys. Without labels, or with too few to prove
    a cutoff, only the base rules decide. Repeated rows give repeated rows; an
    empty table gives an empty result; other columns are ignored.
    """
    text = text_of(docs, text_col)
    work = Written(docs.sparkSession, "quality-rules")
    s = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[stratum_col].cast("string"), F.lit("")).alias("stratum"), signals(text).alias("s"))
    s = work.table(s.select("doc_id", "stratum", "s.w.*", "s.l.*", "s.word_chars", "s.n_symbols"), "signals")
    s = s.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    marks = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.max("quality") == 1).alias("good"))
    labelled = s.join(marks, "doc_id").select("stratum", "good", _levels(s).alias("levels"))
    cuts = cutoffs(labelled, alpha, delta, cost).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    cuts = work.table(cuts, "cutoffs")
    out = s.withColumn("levels", _levels(s))
    if cuts.count() <= broadcast_strata:
        out = out.join(F.broadcast(cuts), "stratum", "left")
    else:
        spread = cuts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        out = out.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(salts)).cast("int")).join(spread, ["stratum", "_salt"], "left")
    failed = F.transform(F.filter("levels", lambda x: F.col("cuts").isNotNull() & (x["level"] >= F.col("cuts")[x["rule"]])), lambda x: x["rule"])
    out = out.withColumn("rules_failed", failed)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return out.select("doc_id", *names, (~F.col("base_failed") & (F.size("rules_failed") == 0)).alias("kept"), F.array_join("rules_failed", ",").alias("rules_failed"))
