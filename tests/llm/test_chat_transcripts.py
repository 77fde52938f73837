"""Transcript parsing: chunked Viterbi against brute force, held-out roles, long and odd transcripts."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from sparkmend.llm import chat_transcripts as C
from sparkmend.llm.common import fold

SF_MID = "/root/testdata/sf0.01"


def viterbi(model, seen):
    """Plain Viterbi over a list of feature tuples."""
    emit = [sum(model.seen[f][:, v] for f, v in zip(C.FEATURES, x)) for x in seen]
    score, back = model.start + emit[0], []
    for e in emit[1:]:
        ways = score[:, None] + model.step + e
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0)
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def random_model(seed=1):
    rng = np.random.default_rng(seed)
    rows = lambda *s: np.log(rng.dirichlet(np.ones(s[-1]), s[:-1] or None))
    return C.Model(rows(C.STATES), rows(C.STATES, C.STATES), {f: rows(C.STATES, n) for f, n in C.FEATURES.items()})


def test_viterbi_is_the_best_path():
    model = random_model()
    seen = [(1, 0, 0, 3), (0, 0, 1, 5), (2, 0, 0, 1), (0, 1, 0, 0)]
    emit = [sum(model.seen[f][:, v] for f, v in zip(C.FEATURES, x)) for x in seen]
    total = lambda p: model.start[p[0]] + sum(model.step[a, b] for a, b in zip(p, p[1:])) + sum(e[s] for e, s in zip(emit, p))
    best = max(itertools.product(range(C.STATES), repeat=4), key=total)
    assert tuple(viterbi(model, seen)) == best


def test_chunks_decode_like_one_piece(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_TURNS", 3)
    monkeypatch.setattr(C, "GROUP_CHUNKS", 4)
    rng = np.random.default_rng(3)
    words = ["User: hi", "Assistant: yes", "why?", "", "a longer line of text with words", "System: be kind", "Q: x", "[AI] ok"]
    turns = [(c, t, "\n".join(rng.choice(words, rng.integers(1, 4)))) for c, n in (("long", 200), ("b", 2), ("c", 1), ("d", 13)) for t in range(n)]
    df = spark.createDataFrame(turns, "conv_id string, turn long, text string")
    rows = C.lines(df)
    model = random_model(4)
    got = {}
    for r in C.decode(rows, model).collect():
        got.setdefault(r.conv, []).append((r.turn, r.line, r.state))
    shown = rows.select("conv", "turn", "line", *[c.alias(f) for f, c in C.features(F.col("content")).items()]).collect()
    for conv, states in got.items():
        seen = sorted((r.turn, r.line, r.marker, r.blank, r.asks, r.length) for r in shown if r.conv == conv)
        assert [s[:2] for s in sorted(states)] == [s[:2] for s in seen]
        assert [s[2] for s in sorted(states)] == viterbi(model, [s[2:] for s in seen])
    lines = C.render(C.decode(rows, model)).orderBy("conv", "turn", "line").collect()
    for conv in got:
        text = "\n".join(r.rendered for r in lines if r.conv == conv)
        numbers = [r.turn_no for r in lines if r.conv == conv]
        assert numbers == sorted(numbers) and numbers[0] == 0
        assert text.endswith("<|end|>") and text.count("<|end|>") >= len(set(numbers))


def test_held_out_roles(spark):
    turns = spark.read.parquet(f"{SF_MID}/conversations.parquet")
    rows = C.lines(C.raw_transcripts(turns))
    model = C.learn(rows.where(fold(F.col("conv"), 4) != 2))
    got = C.render(C.decode(rows, model)).withColumnRenamed("role", "pred")
    both = got.join(rows.groupBy("conv", "turn", "same", "line").agg(F.first("role").alias("role")), ["conv", "turn", "same", "line"])
    held = both.where(fold(F.col("conv"), 4) == 2).agg(F.avg((F.col("role") == F.col("pred")).cast("int"))).first()[0]
    assert held > 0.95 and both.count() == rows.count()


def test_markers(spark):
    texts = ["User: x", "### Response:", "<|assistant|> hi", "[SYSTEM] be", "Q: why", "a plain line", "Answering is hard", "User said: x", "Ai:"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.m for r in df.select(C.features(F.col("t"))["marker"].alias("m")).collect()]
    assert got == [2, 3, 3, 1, 2, 0, 0, 0, 3]


def test_odd_rows(spark):
    rows = [("c1", 0, "user", "hi there?"), ("c1", 1, "assistant", None), ("c1", 1, "assistant", None), (None, 0, "user", "alone"),
            (None, 0, "user", "alone two"), ("c2", None, None, ""), ("c3", 5, "narrator", "once\nupon\n\na time " + "x " * 50_000)]
    df = spark.createDataFrame([r + (1,) for r in rows], "conv_id string, turn long, role string, text string, chunk int")
    raw = C.lines(C.raw_transcripts(df))
    model = C.learn(raw)
    got = C.render(C.decode(raw, model)).collect()
    assert len(got) == raw.count() == 10
    assert len({r.conv for r in got}) == 5
    none = C.learn(raw.limit(0))
    assert C.render(C.decode(raw.limit(0), none)).count() == 0
    assert len(C.render(C.decode(raw, none)).collect()) == 10
