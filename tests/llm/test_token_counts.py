"""Compiled token counts against the tokenizer library."""

import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer as Library

from sparkmend.llm import token_counts as C

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


def texts(seed=1):
    rng = random.Random(seed)
    signs = ["'s", "'re", "'", "'ll", "'lx", " ", "  ", "\n", "\t", " ", "　", "a", "b", "THE", "é", "ß", "中文",
             "😀", "1", "23", "½", ".", "!!", "$", "_", "<|endoftext|>", "<|endoftext", "re", "'v", "e", "\x00", "​",
             "\x1c", "\x85", "'S", " '", "'t's", "ʰ", "²"]
    out = ["", "a", " ", "  a", "a  ", "a \n b", "it's they're we'll I'd 'tis", "a" * 3000, "ab" * 700, " " * 50, "\n\n\n",
           "<|endoftext|>", "x <|endoftext|> y", "aaaaaaaaaaaaaaaa aaaaaaaaaaaaaaaaa"]
    out += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    out += [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 25))) for _ in range(200))
            for _ in range(20)]
    return out


def test_counts_equal_the_library(library):
    tok = C.Tokenizer(open(PATH, "rb").read())
    ts = texts()
    n_bytes, n_tokens = tok.count_batch(ts)
    for t, b, n in zip(ts, n_bytes, n_tokens):
        assert b == len(t.encode()) and n == len(library.encode(t, add_special_tokens=False).ids), repr(t)


def test_chunks_compose_and_tables_may_start_anew(library):
    tok = C.Tokenizer(open(PATH, "rb").read(), max_states=50)
    ts = texts(2)[:300]
    for chunk in (1, 3, 7):
        codes = C.np.frombuffer("".join(ts).encode("utf-32-le"), "<u4")
        assert (tok.splitter.starts(codes, chunk) == tok.splitter.starts(codes, 1000)).all()
    for t in ts[:60]:
        assert tok.count_batch([t])[1][0] == len(library.encode(t, add_special_tokens=False).ids)


def test_rows(spark, library):
    rows = [(1, None, 9), (2, "", 9), (2, "it's 12 o'clock", 9), (2, "it's 12 o'clock", 9), (None, "word " * 600, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = C.count_tokens(df, PATH).collect()
    want = [(len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for _, t, _ in rows]
    assert [(r.n_bytes, r.n_tokens) for r in got] == want
    assert [r.over_limit for r in got] == [n > 512 for _, n in want]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert C.count_tokens(empty, PATH).count() == 0
