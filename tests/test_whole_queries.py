"""Queries take whole tables and whole texts."""

import re

from brindle.plans import catalog


def test_jaccard_pairs_of_texts_of_any_length(spark, tmp_path):
    words = [f"w{i}" for i in range(400)]
    texts = ["a b c d e f g h i j k", "k j i h g f e d c b a", " ".join(words), " ".join(words[:-5] + ["x", "y"]), " ".join(words[:300]), "", None, "a b c", " ".join(words[::-1])]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    sets = {i: set(re.findall(r"[^\W_]+", (t or "").lower())) for i, t in enumerate(texts)}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] | sets[b]}
    rep = {i: min(k for k in sets if sets[k] == w) for i, w in sets.items()}
    want = {(*k, round(v, 6)) for k, v in want.items() if v > 0.9 and (rep[k[0]] == k[0] and rep[k[1]] in (k[1], k[0]))}
    assert len(want) > 2 and any(len(texts[x[0]]) > 300 for x in want)
    assert {tuple(r) for r in catalog.QUERIES["jaccard_pairs"](spark, str(tmp_path)).collect()} == want


def test_a_prompt_holds_whole_texts(spark):
    sf = "/root/testdata/sf0.001"
    prompt = catalog.QUERIES["context_render"](spark, sf).first()["prompt"]
    ids = [int(x) for x in re.findall(r"^\[Source \d+ - doc (\d+)\]$", prompt, re.M)]
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert any(len(docs[i]) > 100 for i in ids)
    assert prompt == "\n---\n".join(f"[Source {k} - doc {i}]\n{docs[i]}" for k, i in enumerate(ids, 1))


def test_every_long_chunk_is_grounded(spark):
    from brindle.operators import chunking
    from brindle.plans.fixtures import chunks

    sf = "/root/testdata/sf0.001"
    all_chunks = {r["chunk_id"] for r in chunking.offsets(chunks(spark, sf)).where("length(text) > 20").collect()}
    assert {r["chunk_id"] for r in catalog.QUERIES["grounding_offsets"](spark, sf).collect()} == all_chunks
