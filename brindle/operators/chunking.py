"""Structure-aware splitting and greedy grouping of documents into chunks, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: what marks structure in markdown
HEADER, FENCE, TABLE = r"(?m)^#{1,6}[ \t]+[^\n]+$", r"```[\s\S]*?```", r"(?m)^\|[^\n]+\|\n\|[-:\s|]+\|\n(?:\|[^\n]+\|\n?)*"


def paragraphs(text: Column) -> Column:
    """Trimmed parts between blank lines."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n", -1), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def elements(text: Column) -> Column:
    """``type, content, section`` of a markdown text, in order.

    Fenced code comes first, so markers inside fences count for nothing; then
    tables, headers and the paragraphs between. A header stays as an element of
    its own and names the section of what follows.
    """
    marked = F.regexp_replace(text, f"({FENCE})|({TABLE.removeprefix('(?m)')})|({HEADER.removeprefix('(?m)')})".join(["(?m)", ""]), "\u0001$0\u0001")
    parts = F.filter(F.transform(F.split(marked, "\u0001", -1), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    kind = lambda p: F.when(p.startswith("```") & p.endswith("```") & (F.length(p) > 5), "code_block").when(p.rlike(r"^#{1,6}[ \t]+[^\n]+$"), "header").when(p.rlike(r"^\|[^\n]+\|\n\|[-:\s|]+\|"), "table").otherwise("paragraph")
    typed = F.transform(parts, lambda p: F.struct(kind(p).alias("type"), p.alias("content")))
    split_ = F.flatten(F.transform(typed, lambda x: F.when(x["type"] == "paragraph", F.transform(paragraphs(x["content"]), lambda p: F.struct(F.lit("paragraph").alias("type"), p.alias("content")))).otherwise(F.array(x))))
    title = lambda x: F.regexp_replace(x["content"], r"^#{1,6}[ \t]+|\s+$", "")
    under = lambda xs, section: F.transform(xs, lambda x: F.struct(x["type"].alias("type"), x["content"].alias("content"), section.alias("section")))

    def sections(xs: Column, heads: Column) -> Column:
        """What lies before the first header, then each header with what follows it: every element is copied once."""
        end = lambda k: F.coalesce(F.get(heads, k + 1), F.size(xs))
        first = F.slice(xs, F.lit(1), F.coalesce(F.get(heads, F.lit(0)), F.size(xs)))
        rest = F.transform(heads, lambda h, k: under(F.slice(xs, h + 1, end(k) - h), title(F.get(xs, h))))
        return F.flatten(F.concat(F.array(under(first, F.lit(None).cast("string"))), rest))

    heads = lambda xs: F.filter(F.transform(xs, lambda x, i: F.when(x["type"] == "header", i)), lambda i: i.isNotNull())
    return _let(split_, lambda xs: _let(heads(xs), lambda h: sections(xs, h)))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Groups are gathered in blocks of so many, so that none is copied with all before it.
_BLOCK = 256


def group_elements(parts: Column, target: int = 1000, most: int = 2000, overlap: int = 150) -> Column:
    """Greedy groups of an array of texts, each an array.

    A group closes before a text once it holds ``target`` characters and has
    reached ``most`` or would pass it; the next begins with the last texts that
    fit into ``overlap``. A single text is never cut. The fold carries places and
    lengths only; texts are sliced at its end.
    """
    none = F.array().cast("array<struct<a:int,b:int>>")
    pair = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    start = F.struct(F.lit(0).alias("a"), F.lit(0).alias("n"), none.alias("block"), F.array().cast("array<array<struct<a:int,b:int>>>").alias("blocks"))

    def tail(sizes: Column, a: Column, i: Column) -> Column:
        # from the end while the sum fits; once one does not, no more are taken
        zero = F.struct(i.alias("a"), F.lit(0).alias("n"), F.lit(True).alias("go"))
        fits = lambda s, k: s["go"] & (s["n"] + F.get(sizes, k) <= overlap)
        step = lambda s, k: F.when(fits(s, k), F.struct(k.alias("a"), (s["n"] + F.get(sizes, k)).alias("n"), F.lit(True).alias("go"))).otherwise(F.struct(s["a"].alias("a"), s["n"].alias("n"), F.lit(False).alias("go")))
        return F.aggregate(F.sequence(i - 1, a, F.lit(-1)), zero, step)

    def groups(sizes: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            x = F.get(sizes, i)
            full = (i > 0) & (s["n"] >= target) & ((s["n"] >= most) | (s["n"] + x > most))
            spilt = F.size(s["block"]) == _BLOCK
            block = F.when(spilt, F.array(pair(s["a"], i))).otherwise(F.concat(s["block"], F.array(pair(s["a"], i))))
            blocks = F.when(spilt, F.concat(s["blocks"], F.array(s["block"]))).otherwise(s["blocks"])
            closed = lambda t: F.struct(t["a"].alias("a"), (t["n"] + x).alias("n"), block.alias("block"), blocks.alias("blocks"))
            return F.when(full, _let(tail(sizes, s["a"], i), closed)).otherwise(F.struct(s["a"].alias("a"), (s["n"] + x).alias("n"), s["block"].alias("block"), s["blocks"].alias("blocks")))

        end = lambda s: F.flatten(F.concat(s["blocks"], F.array(s["block"], F.array(pair(s["a"], F.size(sizes))))))
        return F.when(F.size(sizes) > 0, F.aggregate(F.sequence(F.lit(0), F.size(sizes) - 1), start, step, end)).otherwise(none)

    cut = lambda texts: F.transform(_let(F.transform(texts, F.length), groups), lambda g: F.slice(texts, g["a"] + 1, g["b"] - g["a"]))
    return F.when(parts.isNotNull(), _let(parts, cut))


def chunk_documents(docs: DataFrame, target: int = 1000, most: int = 2000, overlap: int = 150, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, chunk_index, text, char_count, token_count``: paragraphs grouped and joined by a blank line."""
    groups = group_elements(paragraphs(F.col(text_col)), target, most, overlap)
    out = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(groups).alias("chunk_index", "parts")).withColumn("text", F.array_join("parts", "\n\n"))
    return out.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "text", F.length("text").cast("bigint").alias("char_count"), F.floor(F.length("text") / 4).cast("bigint").alias("token_count"))


def link(chunks: DataFrame) -> DataFrame:
    """Adds ``previous_chunk_id, next_chunk_id`` inside each document."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    return chunks.withColumn("previous_chunk_id", F.lag("chunk_id").over(w)).withColumn("next_chunk_id", F.lead("chunk_id").over(w))


def offsets(chunks: DataFrame) -> DataFrame:
    """Adds ``start``: characters of all chunks of the document before."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("start", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).cast("bigint"))
