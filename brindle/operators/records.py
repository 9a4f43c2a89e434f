"""Records out of a model's JSON: parsing, normalising, splitting into good and failed."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: words of the record fields that are accepted, and other names of setups
BIASES = ["bullish", "bearish", "neutral", "unclear"]
SETUPS = ["long", "short", "range", "breakout", "breakdown", "reversal", "continuation"]
SETUP_ALIASES = {"buy": "long", "sell": "short", "long position": "long", "short position": "short"}
CATEGORIES = ["strategy", "indicator", "pattern", "risk_management", "market_structure", "psychology", "fundamental_analysis", "on_chain_analysis", "general"]

#: JSON schemas of the kinds of records that are extracted from a text.
KINDS = {
    "price_targets": "symbol string, price double",
    "trading_setups": "symbol string, setup_type string",
    "entities": "name string, entity_type string",
    "concepts": "name string, category string",
    "relationships": "source string, target string, relation_type string",
}


def parse(raw: DataFrame, schema: str, column: str = "raw") -> DataFrame:
    """Adds ``x``, the record of a JSON text by ``schema``; null where the text is no such object."""
    valid = F.try_parse_json(column).isNotNull()
    return raw.withColumn("x", F.when(valid, F.from_json(column, schema)))


def normalise(records: DataFrame) -> DataFrame:
    """Symbols trimmed in upper case, prices positive and to cents, biases and categories from their lists or a fallback; other rows go."""
    out = records.where(F.col("price") > 0).withColumn("symbol", F.trim(F.upper("symbol"))).withColumn("price", F.round("price", 2))
    return out.withColumn("bias", one_of(F.lower("bias"), BIASES, "unclear")).withColumn("category", category(F.col("category")))


def one_of(value: Column, known: list[str], other: str) -> Column:
    return F.when(value.isin(*known), value).otherwise(other)


def category(value: Column) -> Column:
    """A category in lower case with underscores for blanks; general if it is unknown."""
    return one_of(F.replace(F.lower(value), F.lit(" "), F.lit("_")), CATEGORIES, "general")


def setup_type(value: Column) -> Column:
    """A setup in lower case, an alias by its name; what is unknown stays."""
    low = F.lower(value)
    return reduce(lambda c, x: F.when(low == x[0], x[1]).otherwise(c), SETUP_ALIASES.items(), low)


def entity_type(value: Column, known: list[str]) -> Column:
    """A type in lower case; concept if it is unknown."""
    return one_of(F.lower(value), known, "concept")


def rule_extractors() -> dict[str, Callable[[Column], Column]]:
    """Stand-ins for a model, by pattern: each makes a JSON list of one kind of record out of a text."""

    def each(text: Column, pattern: str, made: dict[str, str]) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        value = lambda x, name, rule: F.regexp_extract(x, rule, 1).cast("double" if name == "price" else "string").alias(name)
        record = lambda x: F.struct(*(value(x, name, rule) for name, rule in made.items()))
        return F.to_json(F.transform(found, record))

    return {
        "price_targets": lambda t: each(t, r"[A-Z]{2,6} target \d+(?:\.\d+)?", {"symbol": r"^([A-Z]+)", "price": r"([0-9.]+)$"}),
        "trading_setups": lambda t: each(t, r"(?:buy|sell|long|short) [A-Z]{2,6}\b", {"symbol": r"([A-Z]+)$", "setup_type": r"^([a-z]+)"}),
        "entities": lambda t: each(t, r"\b[A-Z]{2,6}\b", {"name": r"(.*)"}),
        "concepts": lambda t: each(t, r"(?:strategy|indicator|pattern): [a-z]+", {"category": r"^([a-z]+)", "name": r"([a-z]+)$"}),
        "relationships": lambda t: each(t, r"[A-Z]{2,6} follows [A-Z]{2,6}\b", {"source": r"^([A-Z]+)", "target": r"([A-Z]+)$", "relation_type": r" ([a-z]+) "}),
    }


def extract(texts: DataFrame, extractors: dict[str, Callable[[Column], Column]] | None = None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id`` and for each kind its list of records, all kinds in one pass over the texts.

    An extractor makes a JSON list out of the text. What is no such list becomes
    an empty one, so one kind's failure leaves the others; a null text has none.
    """
    columns = []
    for kind, f in (extractors or rule_extractors()).items():
        raw = f(F.coalesce(F.col(text_col), F.lit("")))
        parsed = F.when(F.try_parse_json(raw).isNotNull(), F.from_json(raw, f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in KINDS[kind].split(', '))}>>"))
        columns.append(F.coalesce(parsed, F.from_json(F.lit("[]"), f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in KINDS[kind].split(', '))}>>")).alias(kind))
    return texts.select(F.col(id_col).alias("id"), *columns)


def first_names(records: Column, most: int = 10) -> Column:
    """The first distinct names of a list of records, in order of the alphabet."""
    return F.slice(F.array_sort(F.array_distinct(F.filter(F.transform(records, lambda x: x["name"]), lambda n: n.isNotNull()))), 1, most)


def batch(items: DataFrame, process: Callable[[Column], Column], column: str = "text") -> DataFrame:
    """Adds ``result`` and ``error`` of every item: a null result is a failure and does not stop the others."""
    out = items.withColumn("result", process(F.col(column)))
    return out.withColumn("error", F.when(F.col(column).isNull(), "no input").when(F.col("result").isNull(), "failed"))


def progress(results: DataFrame) -> DataFrame:
    """One row: ``total, done, failed, success_rate`` of a batch."""
    n, bad = F.count(F.lit(1)), F.count("error")
    return results.agg(n.alias("total"), (n - bad).alias("done"), bad.alias("failed"), F.round(F.when(n > 0, (n - bad) / n).otherwise(0.0), 6).alias("success_rate"))


def split(results: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Good and failed rows."""
    return results.where(F.col(error).isNull()), results.where(F.col(error).isNotNull())
