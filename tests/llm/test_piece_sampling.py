"""Sampled segmentations: exact round trips, sampling frequencies against enumeration, equal reruns, odd rows."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from sparkmend.llm import piece_sampling as S

PATH = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return S.Pieces(open(PATH, "rb").read())


def ways(text, pieces, table):
    """All segmentations of a unit with their weights."""
    if not text:
        return {(): 0.0}
    out = {}
    for n in range(1, len(text) + 1):
        i = table.get(text[:n])
        if i is not None:
            for rest, w in ways(text[n:], pieces, table).items():
                out[(i, *rest)] = w + pieces.weight[i]
    return out


def test_sampling_follows_the_lattice(pieces):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    table = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not sp.is_byte(i)}
    all_ways = ways(S.META + "abode", pieces, table)
    total = sum(math.exp(w) for w in all_ways.values())
    n = 40_000
    ids, count = S.encode_batch(["abode"] * n, np.arange(n).astype("uint64") * np.uint64(7919), pieces)
    got = Counter(tuple(x) for x in np.split(ids, np.cumsum(count)[:-1]))
    assert set(got) <= set(all_ways)
    for way, w in all_ways.items():
        p = math.exp(w) / total
        assert abs(got[way] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_round_trips(pieces):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(5)
    texts = ["", " ", "   ", "a", " a b  c ", "line\nline\t\r\n", "▁ ▁▁x", "naïve façade — 中文 😀\x00​", "x" * 5000, "word " * 5000]
    texts += ["".join(rng.choice("ab é▁中😀\n .") for _ in range(rng.randint(1, 80))) for _ in range(400)]
    ids, n = S.encode_batch(texts, np.arange(len(texts)).astype("uint64"), pieces)
    for t, x in zip(texts, np.split(ids, np.cumsum(n)[:-1])):
        assert S.decode(x.tolist(), pieces) == t
        if S.META not in t:
            assert sp.decode(x.tolist()) == t
    again, m = S.encode_batch(texts[::-1], np.arange(len(texts))[::-1].astype("uint64"), pieces)
    assert all((a == b).all() for a, b in zip(np.split(ids, np.cumsum(n)[:-1]), np.split(again, np.cumsum(m)[:-1])[::-1]))


def test_a_batch_takes_bounded_memory(pieces):
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choice("abcdeio") for _ in range(rng.randint(2, 9))) for _ in range(300)) for _ in range(1200)]
    hi = next(hi for _, hi in S.batches(np.array([len(t) for t in texts]), S.BATCH_CHARS))
    tracemalloc.start()
    S.encode_batch(texts[:hi], np.arange(hi).astype("uint64"), pieces)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 250e6


def test_rows(spark):
    rows = [(1, "some words here", 3), (2, None, 3), (3, "", 3), (1, "some words here", 3), (None, "no key", 3), (4, "w " * 300_000, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_pieces int")
    out = S.encode(df, PATH)
    got = out.collect()
    assert [(r.doc_id, r.text) for r in got] == [(i, t) for i, t, _ in rows]
    assert [r.lossless for r in got] == [True, None, True, True, True, True]
    assert got[1].piece_ids is None and got[1].n_pieces is None and got[2].piece_ids == []
    assert got[0].piece_ids == got[3].piece_ids and all(r.n_pieces == len(r.piece_ids) for r in got if r.text is not None)
    assert {r.piece_ids[0] for r in S.encode(df.where("doc_id = 1"), PATH, seed=5).collect()}
    back = S.decode_rows(out.drop("text"), PATH).collect()
    assert [r.text for r in back] == [t for _, t, _ in rows]
    assert S.encode(df.limit(0), PATH).count() == 0


def test_smaller_batches_give_the_same_pieces(spark):
    df = spark.createDataFrame([(i, f"row {i} has words, é and 日本 " * (i % 40)) for i in range(200)], "doc_id long, text string").coalesce(1)
    few = S.encode(df, PATH, batch_chars=2_000).collect()
    assert few == S.encode(df, PATH).collect()
