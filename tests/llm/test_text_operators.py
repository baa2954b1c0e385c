"""Tokenizers, packing, fingerprints: against the library or a brute-force version."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textrisk.llm import bpe, fingerprints, packing, token_counts
from textrisk.llm.pretokens import BYTE_VOCABULARY, WORD_VOCABULARY, PreTokenizer, library

TEXTS = [
    None, "", " ", "\n\t ", "a", "The cat sat; the CAT sat!", "it's we'll I'd'd ''s", "x" * 5000, "é à ü ß ñ Ça",
    "é Å", "İstanbul ΣΑΣ ﬁ", "日本語 テキスト", "\x00\x01 \x85 ", "a <|endoftext|>b<|startoftext|>",
    "12 3456 ²³ ½", "___ a_b $$$###", "tab\tnew\r\nline  two   spaces ", "😀 emoji 👍🏽", "!" * 700, "word " * 3000,
]


def rows(texts):
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("vocabulary", [WORD_VOCABULARY, BYTE_VOCABULARY])
@given(st.text(max_size=60) | st.text("ab c'sd!\n_é3 <|endoftx>", max_size=60))
@settings(max_examples=300, deadline=None)
def test_pretokens_and_trie_equal_the_library(vocabulary, text):
    pre, tokenizer = PreTokenizer(vocabulary), library(vocabulary)
    trie = _trie(vocabulary)
    found = []
    for word in pre.split(text):
        if word in pre.special:
            found.append(pre.special[word])
        else:
            spelled = pre.spell(word)
            found += [trie.ids[t] for t in trie.encode([spelled])[spelled]]
    assert found == tokenizer.encode(text, add_special_tokens=False).ids


def _trie(vocabulary, cache={}):
    if vocabulary not in cache:
        cache[vocabulary] = bpe.TrieEncoder(vocabulary)
    return cache[vocabulary]


def test_repeated_letters_and_shared_prefixes():
    words = {"a" * n for n in range(1, 90)} | {"!" * n for n in range(1, 90)} | {"aab" * n for n in range(1, 20)}
    model = library(WORD_VOCABULARY).model
    assert _trie(WORD_VOCABULARY).encode(words) == {w: [t.value for t in model.tokenize(w)] for w in words}


def test_round_trip_equals_the_library(documents):
    tokenizer = library(WORD_VOCABULARY)
    got = bpe.bpe_round_trip(documents(rows(TEXTS), extra=True)).collect()
    assert len(got) == len(TEXTS)
    for row in got:
        ids = tokenizer.encode(TEXTS[row["doc_id"]] or "", add_special_tokens=False).ids
        assert bytes(row["ids"]) == struct.pack(f"<{len(ids)}I", *ids)
        assert row["n_tokens"] == len(ids)
        assert row["decoded"] == tokenizer.decode(ids, skip_special_tokens=False)


def test_token_counts_equal_the_library(documents):
    texts = TEXTS * 3
    tokenizer = library(WORD_VOCABULARY)
    found = token_counts.count_tokens(documents(rows(texts), extra=True).repartition(3), buckets=5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in found.collect()}
    expected = {
        i: (len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids))
        for i, t in enumerate(texts)
    }
    assert got == expected


def test_token_counts_keep_repeated_and_null_ids(documents):
    got = token_counts.count_tokens(documents([(1, "a b"), (1, "a b"), (None, "c"), (None, None)])).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got) == [(-1, 0), (-1, 1), (1, 2), (1, 2)]


@pytest.mark.parametrize("function", [bpe.bpe_round_trip, token_counts.count_tokens, packing.pack,
                                      fingerprints.edited_neighbours])
def test_empty_tables_give_empty_results(documents, function):
    assert function(documents([])).count() == 0


# ---- packing ------------------------------------------------------------------------------


def check_packing(pieces, texts):
    """Everything that the contract asks for."""
    tokenizer = library(BYTE_VOCABULARY)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(texts)
    for key, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for p in sorted(by_doc[key], key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            part = ids[at : at + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += p["length"]
        assert at == len(ids)
    for group in by_sequence.values():
        at = 0
        for p in sorted(group, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024 and at & (at - 1) == 0


def test_packing_covers_every_token_without_padding(documents):
    texts = dict(enumerate([*TEXTS, *["the same copy of a text " * 40] * 50]))
    pieces = packing.pack(documents(list(texts.items()), extra=True).repartition(3)).collect()
    check_packing(pieces, texts)


@given(st.integers(1, 4), st.integers(2, 4))
@settings(max_examples=20, deadline=None)
def test_curve_visits_each_cell_once_by_steps_of_one(bits, dimensions):
    side = 1 << min(bits, 8 // dimensions)
    axes = np.meshgrid(*[np.arange(side)] * dimensions, indexing="ij")
    points = np.stack([a.ravel() for a in axes], axis=1)
    keys = packing.hilbert_keys(points, side.bit_length() - 1)
    assert sorted(keys) == list(range(len(points)))
    walk = points[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_alike_documents_get_near_keys():
    english, german = ["the cat and the dog in the house "], ["der hund und die katze in dem haus "]
    encoder = packing.id_encoder(BYTE_VOCABULARY)
    many = [t * n for t in english for n in (50, 51)] + [t * n for t in german for n in (50, 51)]
    points = packing.curve_points([np.frombuffer(i, encoder.width) for i in encoder.encode(many)])
    near = np.abs(points[0] - points[1]).sum() + np.abs(points[2] - points[3]).sum()
    assert near < np.abs(points[0] - points[2]).sum()


# ---- fingerprints -------------------------------------------------------------------------


def plain_hash(data: bytes, at: int) -> int:
    return sum(int(fingerprints.GEAR[data[at - d]]) << d for d in range(min(at + 1, 16))) & 0xFFFF


@given(st.binary(max_size=400))
@settings(max_examples=60, deadline=None)
def test_rolling_hash_equals_its_definition(data):
    got = fingerprints.gear_hashes(np.frombuffer(data, np.uint8))
    assert got.tolist() == [plain_hash(data, i) for i in range(len(data))]


@given(st.lists(st.text(max_size=300), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_chunks_cover_the_text_whatever_stands_next_to_it(texts):
    blobs = [t.encode() for t in texts]
    together = fingerprints.fingerprints(blobs)
    for blob, found in zip(blobs, together, strict=True):
        assert found == fingerprints.fingerprints([blob])[0]
        assert sum(found.values()) <= len(blob) and (not blob or found)
        assert fingerprints.read_back(fingerprints.written(found)) == found
        assert fingerprints.likeness(found, found) == 1.0


def test_an_insertion_changes_few_chunks():
    random = np.random.Generator(np.random.PCG64(1))
    words = ["".join(chr(97 + c) for c in random.integers(0, 26, 6)) for _ in range(600)]
    one, other = " ".join(words), " ".join(words[:300] + ["inserted"] + words[300:])
    a, b = fingerprints.fingerprints([one.encode(), other.encode()])
    assert fingerprints.likeness(a, b) > 0.95


def neighbours_by_brute_force(texts):
    order = sorted(texts, key=lambda k: -k)
    out = {}
    for i, key in enumerate(order):
        text, following = texts[key] or "", texts[order[(i + 1) % len(order)]] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        a, b, c = (fingerprints.fingerprints([t.encode()])[0] for t in (text, edited, following))
        out[key] = (
            len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.written(a), fingerprints.written(b),
            fingerprints.likeness(a, b), fingerprints.likeness(a, c),
        )
    return out


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_neighbours_equal_brute_force(spark, documents, parts):
    texts = {7 * i % 101: t for i, t in enumerate(TEXTS * 2 + ["lorem ipsum dolor " * 30] * 9)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = fingerprints.edited_neighbours(documents(list(texts.items()), extra=True).repartition(4)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == neighbours_by_brute_force(texts)


def test_a_single_document_is_its_own_next(documents):
    (row,) = fingerprints.edited_neighbours(documents([(5, "abcdef")])).collect()
    assert row["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and row["near_next"] == 1.0


def test_repeated_and_null_ids_keep_their_rows(documents):
    got = fingerprints.edited_neighbours(documents([(3, "x"), (3, "x"), (None, "y"), (None, None), (1, "")])).collect()
    assert sorted((r["doc_id"] or -1, r["n_chars"]) for r in got) == [(-1, 0), (-1, 1), (1, 0), (3, 1), (3, 1)]


def test_fingerprint_column(documents):
    got = documents([(1, None), (2, "abc")]).select(fingerprints.fingerprint(F.col("text")).alias("f")).collect()
    assert sorted(r["f"] for r in got) == ["", f"{zlib.crc32(b'abc'):08x}03"]
