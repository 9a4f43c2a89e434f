"""Tokens, record files, packing and the transducer against the tokenizers library."""

import hashlib
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from brindle.llm import bpe, packing, token_records
from brindle.llm.token_cache import CachedEncoder
from tests.llm.fixtures import documents, empty

WORD, BYTE = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))


def library(path):
    """The library as it comes, no setting touched."""
    return Tokenizer.from_file(path)


def ids_of(t, text):
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoders():
    return {p: (library(p), CachedEncoder(p, most_bytes=20_000)) for p in (WORD, BYTE)}, bpe.BpeEncoder(WORD, most_bytes=20_000)


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t  \x1c\x85'’abcst12.,!É̈áßΣİ日本"), st.characters(max_codepoint=0x24F)), max_size=60))
def test_ids_are_the_librarys(encoders, text):
    pairs, own = encoders
    for t, e in pairs.values():
        assert np.frombuffer(e.ids(text), "<u4").tolist() == ids_of(t, text)
    assert own.encode(text) == ids_of(pairs[WORD][0], text)


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("abeinorst"), min_size=1, max_size=400), st.lists(st.integers(1, 60), max_size=12))
def test_the_transducer_is_exact_in_any_blocks(encoders, word, cuts):
    t, own = encoders[0][WORD][0], encoders[1]
    m = own.merges
    tr, out, at = bpe.Transducer(m), [], 0
    for c in cuts:
        if at + c >= len(word):
            break
        out += tr.feed(word[at : at + c])
        at += c
    out += tr.finish(word[at:])
    assert [m.vocab[x] for x in out] == ids_of(t, word)


def test_the_transducer_forgets(encoders):
    m = encoders[1].merges
    tr = bpe.Transducer(m)
    for _ in range(40):
        tr.feed("thereinonathes" * 5)
        assert len(tr.text) < 4 * m.lookahead


def test_decoders(encoders):
    t, own = encoders[0][WORD][0], encoders[1]
    ids = own.encode("Hello wörld, it's 42")
    d = own.decoder()
    assert "".join(d.feed([i]) for i in ids) == t.decode(ids, skip_special_tokens=False)
    text = bpe.TextDecoder(bpe.TextDecoder.table({i: p for p, i in own.merges.vocab.items()}, "</w>"))
    assert "".join(text.feed([i]) for i in ids) + text.feed([], True) == "hello wörld , it 's 4 2 "
    b = library(BYTE)
    pieces = {i: p for p, i in b.get_vocab().items()}
    raw = "naïve 日本 😀"
    down = bpe.TextDecoder(bpe.TextDecoder.table(pieces))
    assert "".join(down.feed([i]) for i in ids_of(b, raw)) + down.feed([], True) == raw


def test_round_trip_of_documents(spark):
    d, rows = documents(spark)
    t = library(WORD)
    want = Counter()
    for r in rows:
        ids = ids_of(t, r[1])
        want[(r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in bpe.bpe_round_trip(d, WORD).collect()) == want
    full = bpe.bpe_round_trip(d, WORD, with_ids=True).where("doc_id = 0").first()
    assert full["ids"] == ids_of(t, rows[0][1])
    assert bpe.bpe_round_trip(empty(spark), WORD).count() == 0


def test_records_round_trip(spark):
    d, rows = documents(spark)
    t = library(WORD)
    manifest, records = token_records.token_records(d, WORD)
    got = sorted(records.collect(), key=lambda r: (r["part"], r["record"]))
    want = sorted(((r[0] is not None, r[0] or 0, r[1] or ""), ids_of(t, r[1]) + [1]) for r in rows)
    at = 0
    for r, (key, ids) in zip(got, want, strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) == (key[1] if key[0] else None, at, len(ids), ids)
        at += len(ids)
    some = got[len(got) // 2]
    path = {m["part"]: m["path"] for m in manifest.collect()}[some["part"]]
    doc, ids = token_records.read_record(path, some["record"])
    assert doc == some["doc_id"] and ids.tobytes() == some["ids"]
    _, none = token_records.token_records(empty(spark), WORD)
    assert none.count() == 0


def test_frames_tell_damage(tmp_path):
    data = token_records.frame(b"payload")
    assert data[:8] == struct.pack("<Q", 7) and len(data) == 8 + 4 + 7 + 4
    for k in (0, 9, 14, len(data) - 1):
        bad = bytearray(data)
        bad[k] ^= 1
        (tmp_path / "x").write_bytes(bytes(bad))
        with pytest.raises(ValueError), open(tmp_path / "x", "rb") as f:
            token_records.read_frame(f)
    for width, ids in ((4, [1, 70000]), (2, [1, 65535]), (4, []), (2, [])):
        payload = token_records.encode_payload(5, np.array(ids, f"<u{width}").tobytes(), width)
        assert token_records.decode_payload(payload)[0] == 5 and token_records.decode_payload(payload)[1].tolist() == ids
    assert token_records.decode_payload(token_records.encode_payload(None, b""))[0] is None


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing_is_gapless_and_whole(spark, capacity):
    d, rows = documents(spark)
    t = library(BYTE)
    docs, sequences, padding = defaultdict(list), defaultdict(list), 0
    for r in packing.pack(d, BYTE, capacity, with_ids=True).collect():
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        sequences[r["sequence_id"]].append(r)
        docs[r["doc_id"]].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity and s[0]["padded_length"] == (at if at & (at - 1) == 0 else capacity)
        padding += s[0]["padded_length"] - at
    want = defaultdict(Counter)
    for r in rows:
        want[r[0]].update(enumerate(ids_of(t, r[1]) + [1]))
    # rows that repeat an id are told apart by nothing but their ids, so places and ids are compared as a whole
    for doc, places in want.items():
        got = Counter()
        for r in docs[doc]:
            got.update(enumerate(np.frombuffer(r["ids"], "<u4").tolist(), r["start"]))
        assert got == places, doc
    assert docs.keys() == want.keys()
    total = sum(r["length"] for s in sequences.values() for r in s)
    assert padding <= 0.03 * total
    assert packing.pack(empty(spark), BYTE).count() == 0


def test_bins_are_closed_by_a_fixed_number_of_whole_documents():
    rng, c = np.random.default_rng(5), 2048
    lengths = np.concatenate((rng.integers(1, 2049, 4000), rng.integers(2049, 30000, 300)))
    rng.shuffle(lengths)
    p = packing.Harmonic(c)
    out = [s for i, n in enumerate(lengths) for s in p.add(i, np.arange(n, dtype="<u4"))]
    poured = list(p.finish())
    assert all(sum(len(x[2]) for x in s) == c for s in out)
    assert all((n := sum(len(x[2]) for x in s)) == c or n & (n - 1) == 0 for s in poured)
    pieces = Counter(x[0] for s in out + poured for x in s)
    covered = Counter()
    for s in out + poured:
        for doc, at, ids, n in s:
            assert n == lengths[doc] and ids.tolist() == list(range(at, at + len(ids)))
            covered[doc] += len(ids)
    assert covered == Counter(dict(enumerate(lengths.tolist())))
    short = [i for i, n in enumerate(lengths) if n <= c]
    assert sum(pieces[i] == 1 for i in short) > 0.8 * len(short)
    for s in out:
        if len(s[0][2]) < c:
            k = c // len(s[0][2])
            assert len(s) >= k and all(c // len(x[2]) == k for x in s[:k])


def test_memory_does_not_grow_with_a_text():
    import tracemalloc

    own = bpe.BpeEncoder(WORD, most_bytes=1 << 20)
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abehinorst"), rng.integers(2, 9))) for _ in range(2000)]
    peaks = []
    for n in (60_000, 600_000):
        text = " ".join(words[i] for i in rng.integers(0, 2000, n)) + " " + "xyzq" * 500 + "."
        for ids in own.stream(text[:100_000]):
            pass
        tracemalloc.start()
        for ids in own.stream(text):
            assert len(ids) < 60_000
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]
    word = "thereinon" * 3000 + "é" * 2000 + "!?" * 1500
    assert own.encode("a " + word + " b") == ids_of(library(WORD), "a " + word + " b")


def test_every_document_of_the_given_tables(spark):
    """Ids of all documents of sf0.01, by both encoders and both files."""
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    own = bpe.BpeEncoder(WORD)
    for path in (WORD, BYTE):
        t, e = library(path), CachedEncoder(path)
        for text, x in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(e.ids(text), "<u4").tolist() == x.ids
            assert path == BYTE or own.encode(text) == x.ids
