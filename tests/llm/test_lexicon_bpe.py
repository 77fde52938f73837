"""Lexicon BPE against the tokenizers library; the automaton is minimal and exact; odd and very long texts."""

import hashlib
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkmend.llm import lexicon_bpe as L
from tests.conftest import SF_SMALL

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def bpe():
    return L.Bpe(L._content(PATH))


def digest(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


ODD = [None, "", " \n\t ", "Hello WORLD's isn't we'll 'tis it''s !!'s o'd'm 12345 ½Ⅷ²", "a<|endoftext|>B <|startoftext|><|endoftext|>> <|endoftext| >",
       "ΣΑΣ ὈΔΥΣΣΕΎΣ İstanbul ẞß ŉ ǅ", "é ́ Ǻ 가 ﬁ ΩÅ", "x\x1cy\x1f z\x85w v　u​t﻿",
       "日本語テキスト 한국어 العربية हिन्दी", "😀😀👍🏽 ðŁ", "՘Ᲊ Ꟛ\U00010d50\U0003d000 new letters", "!" * 50 + "a" * 300, "\x00\x01 nul",
       "abc" * 20_000, "ab " * 30_000, "a" * 10_001]


def test_texts_against_the_library(spark, library):
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(ODD + ODD[:5])], "doc_id long, text string, ids string")
    for words in (0, 20, 1000):
        model = L.learn(docs, PATH, lexicon_words=words)
        got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in L.digests(docs, model).collect()}
        assert got == {i: digest(library, t) for i, t in enumerate(ODD + ODD[:5])}
    rows = L.decode(L.encode(docs, model), model).collect()
    for r in rows:
        assert list(r.ids) == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == library.decode(list(r.ids), skip_special_tokens=False)
    empty = docs.limit(0)
    assert L.digests(empty, L.learn(empty, PATH)).count() == 0


def test_documents_against_the_library(spark, library):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    got = L.digests(docs, L.learn(docs, PATH, lexicon_words=3000))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == sorted((r.doc_id, *digest(library, r.text)) for r in docs.collect())


def test_every_code_point_splits_as_in_the_library(library, bpe):
    letters = {c: b for b, c in enumerate(L.byte_letters())}
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for c in points:
        if unicodedata.category(chr(c)) in ("Cn", "Co") and c % 97:
            continue
        text = f"a{chr(c)}B{chr(c)}{chr(c)}1!"
        split = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))
        assert bpe.words(text) == [bytes(letters[x] for x in w).decode() for w, _ in split], hex(c)


def test_automaton_is_exact_and_minimal(bpe):
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abé"), size=rng.integers(1, 7))) for _ in range(400)}
    table = {w.encode(): bpe.merge(w) for w in words}
    data = L.compile_lexicon(table)
    lexicon = L.Lexicon(data)
    asked = sorted(words | {w + "a" for w in words} | {w[1:] for w in words if len(w) > 1} | {"zzz"})
    place = lexicon.places(asked)
    for w, p in zip(asked, place):
        assert (p >= 0) == (w in words)
        if p >= 0:
            assert lexicon.ids[lexicon.offsets[p]:lexicon.offsets[p + 1]].tolist() == bpe.merge(w)
    # as many states as there are different sets of endings
    prefixes = {w[:i] for w in table for i in range(len(w) + 1)}
    endings = {frozenset(w[len(p):] for w in table if w.startswith(p)) for p in prefixes}
    assert len(lexicon.ends) == len(endings)
    assert L.Lexicon(L.compile_lexicon({})).places(["a"]).tolist() == [-1]


def test_heap_and_scan_agree(bpe):
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 8, 30, 39):
        for _ in range(40):
            data = rng.choice(np.frombuffer(b"etaoinshr", "uint8"), n)
            ids = [bpe.first[b] for b in data[:-1]] + [bpe.final[data[-1]]]
            assert bpe._scanned(list(ids)) == bpe._by_heap(list(ids))


def test_chunks_cut_before_white_space(monkeypatch):
    monkeypatch.setattr(L, "CHUNK_POINTS", 5)
    for text in ("", "abc", "abcdefgh ijk lm", "a b c d e f g", "abcdefghijkl", "abcde \n fghij  "):
        parts = list(L.chunks(text))
        assert "".join(parts) == text and all(p[0].isspace() for p in parts[1:])
