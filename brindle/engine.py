"""One object for a collection of tables: ingest, search in every mode, context, graph, stores.

Tables are held by name; each method is a composition of the operators and
returns a DataFrame, so that nothing runs before its result is asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.config import Settings
from brindle.errors import AlreadyExists, InvalidArgument
from brindle.functions.text import tokens
from brindle.functions.vector import hashing_embedder
from brindle.operators import chunking, graph, index, knowledge, rag, search, store
from brindle.operators.segments import IndexStore
from brindle.sources import files

MODES = ("keyword", "semantic", "hybrid", "dual")


class Engine:
    """``documents(document_id, text, domain)``, ``chunks(chunk_id, document_id, chunk_index, text, embedding)``, ``entities``, ``relations``, ``mentions``.

    ``embedder`` maps a text column to a vector column and ``scorer`` a text
    column and query terms to a score; both have deterministic stand-ins. With an
    ``index`` of the chunks, keyword search without a filter reads it and no text;
    it follows what is ingested and deleted here.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, settings: Settings | None = None, embedder: Callable[[Column], Column] | None = None, scorer=search.overlap_scorer, index: IndexStore | None = None):
        self.index = index
        self.spark, self.tables, self.settings = spark, dict(tables or {}), settings or Settings()
        self.embedder = embedder or (lambda text: hashing_embedder(tokens(text)))
        self.scorer = scorer

    # collections

    def create(self, name: str, rows: DataFrame) -> None:
        if self.spark.catalog.tableExists(name):
            raise AlreadyExists(f"collection {name} exists")
        rows.write.saveAsTable(name)

    def collections(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables() if not t.isTemporary)

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS `{name}`")

    def query(self, sql: str, **args) -> DataFrame:
        """Any SQL over the tables, with named parameters."""
        for name, d in self.tables.items():
            d.createOrReplaceTempView(name)
        return self.spark.sql(sql, args=args or None)

    # ingest

    def ingest(self, folder: str, processed: str, vision=None) -> DataFrame:
        """New documents of a folder, converted, hashed and chunked; returns the files that failed. Content that is known is left out."""
        found = files.scan(self.spark, folder, most_mb=self.settings.max_file_mb)
        new = self.fresh(files.route(found, processed, vision))
        made = self.chunk(new)
        if self.index is not None:
            self.index.update(made, "chunk_id")
        self.tables["documents"] = self.tables["documents"].unionByName(new, True) if "documents" in self.tables else new
        self.tables["chunks"] = self.tables["chunks"].unionByName(made, True) if "chunks" in self.tables else made
        return found.where("not ok").select("path", "error")

    def fresh(self, routed: DataFrame) -> DataFrame:
        """Documents out of ``path, content, raw_hash`` whose content, before conversion, is not known yet; each once."""
        new = routed.select(F.concat(F.lit("doc_"), F.substring("raw_hash", 1, 16)).alias("document_id"), F.col("raw_hash").alias("content_hash"), F.col("content").alias("text"), F.col("path").alias("source_uri")).dropDuplicates(["document_id"])
        return new.join(self.tables["documents"].select("document_id"), "document_id", "left_anti") if "documents" in self.tables else new

    def chunk(self, documents: DataFrame) -> DataFrame:
        s = self.settings
        c = chunking.chunk_documents(documents, s.chunk_size, s.max_chunk_size, s.chunk_overlap, id_col="document_id").withColumnRenamed("doc_id", "document_id")
        c = c.withColumn("chunk_id", F.concat_ws(":", "document_id", F.col("chunk_index").cast("string")))
        return c.withColumn("embedding", self.embedder(F.col("text")))

    # search

    def _filtered(self, domain: str | None, where: dict | None) -> DataFrame:
        c = self.tables["chunks"]
        if domain:
            c = c.join(self.tables["documents"].where(F.col("domain") == domain).select("document_id"), "document_id", "left_semi")
        return c.where(store.metadata_filter(where)) if where else c

    def keyword(self, text: str, limit: int = 10, mode: str = "or", domain: str | None = None, where: dict | None = None) -> DataFrame:
        """BM25 over the chunks; a text without words finds nothing."""
        if not (terms := self.terms(text)):
            return self.tables["chunks"].select(F.col("chunk_id").alias("id"), F.lit(0.0).alias("score")).where("false")
        if self.index is not None and not domain and not where:
            return index.search(self.index.index(), " ".join(terms), mode, limit).select("id", "score")
        return search.bm25(self._filtered(domain, where), terms, mode, limit, id_col="chunk_id").select("id", "score")

    def semantic(self, text: str, limit: int = 10, domain: str | None = None, where: dict | None = None, least: float | None = None) -> DataFrame:
        q = self.spark.createDataFrame([(text,)], "t string").select(self.embedder(F.col("t")).alias("q"))
        return search.nearest(self._filtered(domain, where), q, limit, least, id_col="chunk_id")

    def hybrid(self, text: str, limit: int = 10, domain: str | None = None, where: dict | None = None) -> DataFrame:
        s = self.settings
        return search.hybrid(self.keyword(text, 2 * limit, domain=domain, where=where), self.semantic(text, 2 * limit, domain, where), limit, s.rrf_k, (s.bm25_weight, s.vector_weight))

    def dual(self, text: str, limit: int = 10) -> DataFrame:
        """Hybrid hits, and at a constant score chunks of the entities that these mention and of the largest communities' leading ones."""
        s, m = self.settings, self.tables["mentions"]
        hits = self.hybrid(text, limit).select(F.col("id").alias("chunk_id"), "score")
        of = m.join(hits, "chunk_id", "left_semi").select(F.col("entity_id").alias("id")).distinct()
        out = rag.feed_by_graph(hits, of, m, score=s.graph_score)
        if "community" in (self.tables["entities"].columns if "entities" in self.tables else ()):
            e = self.tables["entities"].where("community is not null").select(F.col("community").alias("community_id"), F.col("id").alias("entity_id"))
            sizes = e.groupBy("community_id").agg(F.count(F.lit(1)).alias("entity_count"))
            members = e.join(m.groupBy("entity_id").agg(F.count(F.lit(1)).alias("weight")), "entity_id")
            more = rag.community_chunks(sizes, members, m).join(out.select("chunk_id"), "chunk_id", "left_anti")
            out = out.unionByName(more.select("chunk_id", F.lit(s.graph_score).alias("score"), F.lit("community").alias("origin")))
        return out.withColumnRenamed("chunk_id", "id")

    def search(self, text: str, mode: str = "hybrid", limit: int = 10) -> DataFrame:
        if mode not in MODES or limit < 1:
            raise InvalidArgument(f"mode must be one of {MODES} and limit at least 1")
        return getattr(self, mode)(text, limit)

    def many(self, texts: list[str], limit: int = 10) -> DataFrame:
        """One ranking for several wordings of a query."""
        if not texts:
            raise InvalidArgument("queries cannot be empty")
        lists = [self.hybrid(t, 2 * limit).select(F.lit(i).alias("query"), "id", "score") for i, t in enumerate(texts)]
        out = lists[0]
        for x in lists[1:]:
            out = out.union(x)
        return search.multi_query(out, self.settings.rrf_k).orderBy(F.desc("score"), "id").limit(limit)

    def reranked(self, text: str) -> DataFrame:
        """Hybrid candidates reordered by the scorer; the plain order if no scorer is set."""
        s = self.settings
        if not text.strip():
            raise InvalidArgument("the query is empty", field="query")
        if not 1 <= s.final_top_k <= s.initial_top_k:
            raise InvalidArgument("final_top_k must lie in 1..initial_top_k", field="final_top_k")
        hits = self.hybrid(text, s.initial_top_k)
        if self.scorer is None:
            return hits.limit(s.final_top_k)
        return search.rerank(hits, self.tables["chunks"], self.terms(text), s.final_top_k, self.scorer, id_col="chunk_id")

    def corrective(self, text: str, limit: int = 10) -> DataFrame:
        """Hits in three classes of relevance; where none is correct, those of the query without its rarest term."""
        verdicts = rag.corrective_buckets(self.hybrid(text, 2 * limit))
        if verdicts.where("verdict != 'incorrect'").limit(1).count() or len(terms := self.terms(text)) < 2:
            return verdicts
        have = self.tables["chunks"].select(F.array_distinct(tokens(F.col("text"))).alias("t"))
        counts = have.agg(*(F.sum(F.array_contains("t", t).cast("int")).alias(t) for t in terms)).first()
        rarest = min(terms, key=lambda t: (counts[t] or 0, t))
        return rag.corrective_buckets(self.hybrid(" ".join(t for t in terms if t != rarest), 2 * limit))

    def context(self, text: str, mode: str = "hybrid") -> DataFrame:
        """The prompt's context: hits without near-repeats, packed into the token budget and rendered."""
        s = self.settings
        hits = search.ranked(self.search(text, mode, s.max_context_chunks).select("id", "score"))
        texts = self.tables["chunks"].select(F.col("chunk_id").alias("id"), "text", F.col("document_id").alias("name")).join(F.broadcast(hits), "id").withColumn("query_id", F.lit(1))
        kept = rag.greedy_dedup(texts.withColumn("w", F.array_distinct(F.split(F.lower("text"), r"\s+"))))
        packed = rag.pack_context(texts.join(kept.select("id"), "id", "left_semi"), s.max_context_tokens, s.max_context_chunks)
        return rag.render_context(packed.join(texts.select("id", "name"), "id"))

    @staticmethod
    def terms(text: str) -> list[str]:
        """A query's terms: lower-case runs of letters and digits, so that marks in a question do no harm."""
        return ["".join(x) for x in _runs(text.lower())]

    # graph, knowledge, stores

    def traverse(self, start: str, max_depth: int = 2, relation_types: list[str] | None = None, limit: int = 100) -> tuple[DataFrame, DataFrame]:
        r = self.tables["relations"]
        nodes = graph.bfs(r, self.spark.createDataFrame([(start,)], "id string"), max_depth, relation_types, limit)
        return nodes, graph.edges_between(r, nodes)

    def entity(self, entity_id: str, limit: int = 100) -> tuple[DataFrame, DataFrame]:
        return self.tables["entities"].where(F.col("id") == entity_id), graph.relationships(self.tables["relations"], entity_id, limit=limit)

    def detect_domain(self, documents: DataFrame, ontology: DataFrame) -> DataFrame:
        return knowledge.primary_domain(documents, knowledge.domain_scores(documents, ontology))

    def delete_document(self, key: str) -> None:
        """A document with its chunks, their mentions and vectors."""
        gone = self.tables["chunks"].where(F.col("document_id") == key).select("chunk_id")
        if self.index is not None:
            self.index.delete(gone.withColumnRenamed("chunk_id", "id"))
        if "mentions" in self.tables:
            self.tables["mentions"] = self.tables["mentions"].join(gone, "chunk_id", "left_anti")
        for name in ("chunks", "documents"):
            self.tables[name] = self.tables[name].where(F.col("document_id") != key)

    def stats(self) -> dict[str, int]:
        return {name: d.count() for name, d in sorted(self.tables.items())}


def _runs(text: str) -> list[str]:
    out, cur = [], []
    for c in text + " ":
        if c.isalnum():
            cur.append(c)
        elif cur:
            out.append("".join(cur))
            cur = []
    return list(dict.fromkeys(out))


# model gateway: the choice among models, without any call

# fixed values: providers and the name parts that tell them, in the order in which they are tried
PROVIDERS = {
    "kimi": ["kimi", "moonshot"], "qwen": ["qwen", "alibaba", "qwen-max", "qwen-plus"], "glm": ["glm", "zhipu", "chatglm"], "deepseek": ["deepseek"], "gemini": ["gemini", "google"],
    "gpt": ["gpt", "openai"], "claude": ["claude", "anthropic"], "llama": ["llama", "meta"], "mistral": ["mistral"],
}


def provider(name: Column, owner: Column | None = None) -> Column:
    """A model's provider by its name or owner; else the owner's first part."""
    owner = F.lit("") if owner is None else owner
    out = F.when(F.lit(False), "")
    for who, parts in PROVIDERS.items():
        for part in parts:
            out = out.when(F.lower(name).contains(part) | F.lower(owner).contains(part), who)
    return out.otherwise(F.split(owner, "/", 2)[0])


def recommend(models: DataFrame, by: str = "task") -> DataFrame:
    """Of ``name, priority, healthy`` the model for each task or provider: healthy ones first, then the least priority, then the name."""
    return models.groupBy(by).agg(F.min(F.struct((~F.col("healthy")).alias("h"), "priority", "name")).alias("x")).select(by, F.col("x.name").alias("name"))


def fallback(models: DataFrame, without: str | None = None) -> DataFrame:
    """One model of any provider but one: the providers by priority, in each a healthy model before others."""
    left = models.where(F.lower("provider") != without.lower()) if without else models
    return left.orderBy("priority", "provider", F.desc("healthy"), "name").limit(1)
