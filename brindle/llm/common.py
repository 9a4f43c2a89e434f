"""What the corpus operators share: the shared folder, written intermediate tables and text helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.shared import Written, clean, setting, shared_dir, small_batches

__all__ = ["SPACES", "Written", "clean", "let", "setting", "shared_dir", "small_batches", "text_of"]

#: Word separators of the contracts: space and the five ASCII control spaces.
SPACES = r"[\x20\x09-\x0D]"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row, whatever the optimizer inlines."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(docs: DataFrame, text_col: str = "text") -> Column:
    """The text column as a string; null counts as empty."""
    return F.coalesce(docs[text_col].cast("string"), F.lit(""))
