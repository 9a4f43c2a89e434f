"""Files and tables as documents: MIME types, validation, readers and converters, without Python on the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: extensions and their MIME types
MIME = {
    ".pdf": "application/pdf", ".doc": "application/msword", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".webp": "image/webp",
    ".txt": "text/plain", ".md": "text/markdown", ".markdown": "text/markdown", ".rst": "text/x-rst",
    ".html": "text/html", ".htm": "text/html", ".json": "application/json", ".csv": "text/csv",
}
OTHER = "application/octet-stream"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def mime_type(path: Column) -> Column:
    ext = F.regexp_extract(F.lower(path), r"(\.[a-z0-9]+)$", 1)
    return reduce(lambda c, kv: c.when(ext == kv[0], kv[1]), MIME.items(), F.when(F.lit(False), "")).otherwise(OTHER)


def scan(spark: SparkSession, folder: str, recursive: bool = True, most_mb: int = 100) -> DataFrame:
    """``path, length, content, mime_type, ok, error`` of a folder's files; what is too large or unknown is told, not raised."""
    return checked(spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder), most_mb)


def checked(files: DataFrame, most_mb: int = 100) -> DataFrame:
    """``path, length, content, mime_type, ok, error`` of ``path, length, content`` rows."""
    d = files.withColumn("mime_type", mime_type(F.col("path")))
    text = F.col("mime_type").startswith("text/") | (F.col("mime_type") == "application/json")
    error = (
        F.when(F.col("length") > most_mb * 1024 * 1024, "file too large").when(F.col("mime_type") == OTHER, "unsupported extension").when(F.col("length") == 0, "empty file")
        .when(text & ~F.is_valid_utf8(F.col("content").cast("string")), "not utf-8").when((F.col("mime_type") == "application/json") & ~_is_json(F.col("content").cast("string")), "not json")
    )
    return d.select("path", "length", "content", "mime_type", error.isNull().alias("ok"), error.alias("error"))


def _is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing after it, where ``try_parse_json`` takes a value with anything behind. What could follow inside a list cannot follow inside an object."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()


def route(files: DataFrame, processed: str, vision=None) -> DataFrame:
    """``path, content, processor, raw_hash`` by MIME type; the hash is that of the file's own content, before it is converted. ``vision`` is a function of a DataFrame for PDF and images; without one they are left out."""
    d = files.where("ok").withColumn("text", F.decode(F.col("content"), "utf-8"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    kind = F.when(F.col("mime_type") == "text/html", "html").when(F.col("mime_type") == "application/json", "json").when(F.col("mime_type") == "text/csv", "csv").when(F.col("mime_type").startswith("text/"), "text").otherwise("vision")
    d = d.withColumn("processor", kind)
    content = F.when(kind == "html", html_text(F.col("text"))).when(kind == "json", json_markdown(F.col("text"))).when(kind == "csv", csv_text_markdown(name, F.col("text"))).when(F.col("mime_type") == "text/markdown", frontmatter(F.col("text"), name, processed)).otherwise(F.col("text"))
    d = d.withColumn("raw_hash", F.sha2("content", 256))
    out = d.where("processor != 'vision'").select("path", content.alias("content"), "processor", "raw_hash")
    seen = vision(d.where("processor = 'vision'").select("path", "content", "mime_type", "raw_hash")) if vision else None
    return out if seen is None else out.unionByName(seen.select("path", "content", F.lit("vision").alias("processor"), "raw_hash"))


def frontmatter(text: Column, name: Column, processed: str) -> Column:
    """Adds frontmatter to markdown that has none. The time is a parameter, and ids hash the raw content."""
    head = F.concat(F.lit("---\nsource: "), name, F.lit(f"\nprocessed: {processed}\n---\n\n"))
    return F.when(text.startswith("---"), text).otherwise(F.concat(head, text))


def html_text(html: Column) -> Column:
    """Text of a page by patterns: scripts, styles, navigation and footers go, each tag ends a line, blank lines collapse."""
    out = html
    for tag in ("script", "style", "nav", "footer"):
        out = F.regexp_replace(out, f"(?is)<{tag}[^>]*>.*?</{tag}>", "\n")
    out = F.regexp_replace(F.regexp_replace(out, "(?s)<!--.*?-->", "\n"), "(?s)<[^>]*>", "\n")
    for k, v in ENTITIES.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return F.regexp_replace(F.regexp_replace(out, r"[ \t\r\n]*\n[ \t\r\n]*", "\n"), r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def _pretty(text: Column) -> Column:
    """A JSON object with one member a line; members' own values stay on their line."""
    members = F.map_entries(F.from_json(text, "map<string,variant>"))
    lines = F.transform(members, lambda m: F.concat(F.lit("  "), F.to_json(F.array(m["key"])).substr(F.lit(2), F.length(F.to_json(F.array(m["key"]))) - 2), F.lit(": "), F.to_json(m["value"])))
    return F.when(F.size(members) == 0, "{}").otherwise(F.concat(F.lit("{\n"), F.array_join(lines, ",\n"), F.lit("\n}")))


def json_markdown(text: Column) -> Column:
    """A fenced block for an object, one for each item of a list, the text itself for anything else."""
    items = F.from_json(text, "array<variant>")
    item = lambda x: F.when(F.to_json(x).startswith("{"), _pretty(F.to_json(x))).otherwise(F.to_json(x))
    blocks = F.array_join(F.transform(items, lambda x, i: F.concat(F.lit("## Item "), (i + 1).cast("string"), F.lit("\n\n```json\n"), item(x), F.lit("\n```\n\n"))), "")
    first = F.substring(F.ltrim(text), 1, 1)
    return F.when(first == "[", F.concat(F.lit("# Data\n\n"), blocks)).when(first == "{", F.concat(F.lit("# Data\n\n```json\n"), _pretty(text), F.lit("\n```\n"))).otherwise(F.concat(F.lit("# Data\n\n"), text))


def markdown_table(title: Column | str, header: Column, rows: Column, shown: int = 99) -> Column:
    """A table from arrays of cells; what is not shown is counted in the footer."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |\n"))
    title = F.lit(title) if isinstance(title, str) else title
    more = F.when(F.size(rows) > shown, F.concat(F.lit("\n*...and "), (F.size(rows) - shown).cast("string"), F.lit(" more rows*\n"))).otherwise("")
    return F.concat(F.lit("# "), title, F.lit("\n\n"), line(header), line(F.transform(header, lambda _: F.lit("---"))), F.array_join(F.transform(F.slice(rows, 1, shown), line), ""), more)


def csv_text_markdown(name: Column, text: Column) -> Column:
    """A CSV file's text as a table; fields in double quotes may hold commas and line breaks."""
    cells = lambda x: F.transform(F.regexp_extract_all(F.concat(F.lit(","), x), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1)), lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c))
    # every second part between double quotes lies inside them: its line breaks are no ends of rows
    held = F.array_join(F.transform(F.split(text, '"', -1), lambda x, i: F.when(i % 2 == 1, F.replace(x, F.lit("\n"), F.lit("\u0001"))).otherwise(x)), '"')
    lines = F.filter(F.split(held, r"\r?\n", -1), lambda x: x != "")
    back = lambda x: F.transform(cells(x), lambda c: F.replace(c, F.lit("\u0001"), F.lit("\n")))
    return F.when(F.size(lines) == 0, "").otherwise(markdown_table(F.regexp_replace(name, r"\.[^.]*$", ""), back(F.get(lines, 0)), F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1))), back)))


def table_markdown(d: DataFrame, title: str, columns: list[str], order: list[str], shown: int = 99) -> DataFrame:
    """``content``: a table's first rows by a total order as markdown, with the number of the others. Only the shown rows meet in one task."""
    cells = F.array(*(F.col(c).cast("string") for c in columns))
    first = d.orderBy(*order).limit(shown).select(*order, cells.alias("cells")).agg(F.array_sort(F.collect_list(F.struct(*order, "cells"))).alias("r"))
    total = d.agg(F.count(F.lit(1)).alias("n"))
    text = markdown_table(title, F.array(*map(F.lit, columns)), F.transform("r", lambda x: x["cells"]), shown)
    more = F.when(F.col("n") > shown, F.concat(F.lit("\n*...and "), (F.col("n") - shown).cast("string"), F.lit(" more rows*\n"))).otherwise("")
    return first.join(F.broadcast(total)).select(F.concat(text, more).alias("content"))
