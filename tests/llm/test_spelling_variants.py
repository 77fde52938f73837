"""Spelling variants: near words, forms and roots against brute force; shard borders, long words, odd rows."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkmend.llm import spelling_variants as S
from tests.conftest import SF_SMALL

LOWER = str.maketrans(S.UPPER, S.LOWER)


def brute_vocabulary(docs):
    n = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def brute_near(vocab):
    """By words with one code point left out: near words share one, or one is the other's."""
    shorter = defaultdict(set)
    for w in vocab:
        for i in range(len(w)):
            shorter[w[:i] + w[i + 1:], i].add(w)
    by_cut = defaultdict(set)
    for (cut, _), ws in shorter.items():
        by_cut[cut] |= ws
    near = defaultdict(set)
    for ws in shorter.values():  # replaced: the same place left out
        for a in ws:
            near[a] |= ws - {a}
    for w in vocab:  # deleted and inserted
        for longer in by_cut.get(w, ()):
            near[w].add(longer)
            near[longer].add(w)
    return near


def brute_groups(vocab, ratio=10):
    near, form = brute_near(vocab), {}
    for w, n in vocab.items():
        best = min(near[w], key=lambda x: (-vocab[x], x), default=None)
        form[w] = best if best is not None and vocab[best] >= ratio * n else None
    out = {}
    for w, n in vocab.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n, len(near[w]), form[w], vocab[form[w]] if form[w] else None, root)
    return out


def collected(df):
    rows = [tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: r[1:] for r in rows}


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    vocab = brute_vocabulary([tuple(r) for r in docs.collect()])
    found = S.vocabulary(docs)
    assert {r.word: r.n for r in found.collect()} == vocab
    assert collected(S.group_variants(found, shard_words=500)) == brute_groups(vocab)


@pytest.mark.parametrize("shard_words", [7, 60, 10_000])
def test_dense_words_over_shard_borders(spark, shard_words):
    rng = np.random.default_rng(3)
    vocab = {"".join(rng.choice(list("aabé"), size=rng.integers(7, 10))): int(10 ** rng.integers(0, 5)) for _ in range(300)}
    got = collected(S.group_variants(spark.createDataFrame(list(vocab.items()), "word string, n long"), shard_words=shard_words))
    assert got == brute_groups(vocab)


def test_index_finds_each_pair_once():
    words = ["aaaaaaa", "aaaaaaaa", "aaaaaab", "aaabaaa", "baaaaaa", "aaaaaaÿ"]
    who, got = S.Vocabulary(words).near(words, np.full(len(words), 3))
    pairs = sorted(zip(who.tolist(), got.tolist()))
    near = brute_near(words)
    assert pairs == sorted((i, j) for i, a in enumerate(words) for j, b in enumerate(words) if b in near[a] and a[:3] == b[:3])


def test_long_words_and_chains(spark):
    long = "ab" * 20_000
    vocab = {long: 5, long + "b": 60, "a" * 30_000: 2, "a" * 30_001: 20, "a" * 30_002: 200, "aaaaaaa" + "c": 2}
    assert collected(S.group_variants(spark.createDataFrame(list(vocab.items()), "word string, n long"))) == brute_groups(vocab)
    chain = {"abcdefg" + "h" * i: 10 ** (17 - i) * 2 for i in range(18)}
    got = collected(S.group_variants(spark.createDataFrame(list(chain.items()), "word string, n long")))
    assert got == brute_groups(chain) and {v[-1] for v in got.values()} == {"abcdefg"}


def test_odd_rows(spark):
    rows = [(None, "Spelling spelling", "x"), (1, None, "x"), (2, "", "x"), (2, "SPELLING speling× spelling", "x"), (2, "SPELLING speling× spelling", "x"),
            (4, "ÉlèvesÀß élèvesÀß word " + "spelling " * 40, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    vocab = brute_vocabulary([r[:2] for r in rows])
    assert len(vocab) >= 2 and collected(S.group_variants(S.vocabulary(docs))) == brute_groups(vocab)
    assert S.group_variants(S.vocabulary(docs.where("doc_id = 1"))).count() == 0
    assert S.group_variants(S.vocabulary(docs.limit(0))).count() == 0


def test_ties_go_to_the_smaller_word(spark):
    vocab = {"abcdefg": 1 + 1, "abcdefx": 40, "abcdefh": 40, "abcdefé": 40}
    got = collected(S.group_variants(spark.createDataFrame(list(vocab.items()), "word string, n long")))
    assert got == brute_groups(vocab) and got["abcdefg"][2] == "abcdefh"
