"""Texts of results, as callers of the engine know them."""

# fixed values: wording of results

# why a document is ranked as it is
RANK_HEAD = "Document ranked highly due to: "
RANK_VECTOR = "strong semantic match (high vector score)"
RANK_KEYWORD = "relevant keyword match (BM25)"
RANK_HIGH = "high cross-encoder relevance"
RANK_LOW = "low cross-encoder relevance"
RANK_BOTH = "found by both vector and keyword search"
RANK_ELSE = "moderate relevance across methods"
RANK_TAIL = ". Cross-encoder relevance: "

# what is wrong with an entity or an edge
TEMPLATE = "Description for "
NO_TYPE = "Entity missing entity_type"
UNKNOWN_TYPE = "Unknown entity type: "
UNKNOWN_EDGE = "Unknown edge type: "
NO_SOURCE = "Edge missing source_id"
NO_TARGET = "Edge missing target_id"

# what comes before a context's chunks
ENTITIES_HEAD = "## Relevant Entities\n\n"
GRAPH_HEAD = "## Related Knowledge\n\n### Entities\n"
RELATIONS_HEAD = "\n\n### Relationships\n"

# communities: what each level is called, a summary and the request for a name
LEVELS = {"macro": "broad thematic category", "meso": "sub-topic or theme", "micro": "specific entity or concept", "nano": "atomic entity"}
SUMMARY = ("Contains ", " entities of types: ", ". Key entities: ", "Unnamed entities")
NAMING = (
    "Generate a concise name (2-5 words) for this ", ":\n\nSummary: ", "\nKey entities: ", "\nEntity count: ",
    "\n\nRespond with a JSON object with keys 'name' (string) and 'confidence' (number 0.0-1.0).\nExample: {\"name\": \"Machine Learning Systems\", \"confidence\": 0.85}",
)
METRICS = {
    "documents_processed_total": "Total documents processed", "documents_failed_total": "Total documents failed", "entities_extracted_total": "Total entities extracted", "relationships_extracted_total": "Total relationships extracted",
    "success_rate": "Share of documents that succeeded", "processing_ms_avg": "Average processing time",
}
