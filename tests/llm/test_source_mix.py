"""Mixing: targets against plain water-filling, block use, whole pieces, odd rows, equal reruns."""

import numpy as np
from pyspark.sql import functions as F

from sparkmend.llm import source_mix as M


def brute_targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(target.values())
        w = sum(weight[s] for s in free)
        share = {s: left * weight[s] / w for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            free.discard(s)
    return target


def frame(spark, n=400, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(i, " ".join(f"w{j}" for j in range(int(rng.integers(1, 300)))),
             str(rng.choice(["b", "a", "é", "zz", "hot", "hot", "hot"])), 7) for i in range(n)]
    rows += [(n, None, "a", 1), (n + 1, "", "b", 1), (n + 2, "x y", None, 1), (n + 3, None, "none", 1),
             (n + 4, "p q\tr", "a", 1), (n + 4, "p q\tr", "a", 1), (None, "null id", "a", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def test_targets_and_taken(spark):
    df = frame(spark)
    rows = M.mix_counts(df).collect()
    assert len(rows) == df.count()
    sizes = {r.source: r.n for r in df.groupBy("source").agg(
        F.sum(F.size(M.word_array(F.col("text")))).alias("n")).collect()}
    want, of = brute_targets(sizes), {r.doc_id: r.source for r in df.collect()}
    taken = {}
    for r in rows:
        s = of[r.doc_id]
        assert abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and r.source_size == sizes[s]
        assert 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= M.BLOCK_WORDS, (s, taken[s], t)
    assert sorted(map(repr, rows)) == sorted(map(repr, M.mix_counts(df.repartition(5)).collect()))


def test_shards_partition_the_slots():
    for slots, shards in ((0, 3), (1, 5), (1000, 7), (12345, 64), (3, 10**6)):
        got = M.drawn_shards(1, 2, slots, shards, 0, shards)
        assert sum(n for _, _, n in got) == slots and all(n > 0 for _, _, n in got)
        assert all(i < j and a + n == b for (i, a, n), (j, b, _) in zip(got, got[1:]))
        for step in (1, 3, 100) if shards < 100 else (250_000,):  # runs of shards find the same
            assert [g for lo in range(0, shards, step) for g in M.drawn_shards(1, 2, slots, shards, lo, lo + step)] == got


def test_many_sources_and_shards(spark, monkeypatch):
    """Each slot once, dealt by many tasks and in small rows; sources of few slots make few rows."""
    df = frame(spark)
    sources = M.source_targets(df.select("source", F.size(M.word_array(F.col("text"))).cast("long").alias("size")))
    want = sorted(map(tuple, M.draw_slots(sources, slots_per_shard=10).collect()))
    monkeypatch.setattr(M, "SLOTS_A_ROW", 7)
    monkeypatch.setattr(M, "SLOTS_A_TASK", 100)
    got = M.draw_slots(sources, slots_per_shard=10)
    assert sorted(map(tuple, got.collect())) == want
    assert len({(r.source_no, r.slot) for r in got.collect()}) == len(want) and got.rdd.getNumPartitions() > 4


def test_very_long_text(spark):
    """A text of 200,000 words beside short ones: its pieces reach the target, none twice more than allowed."""
    rows = [(1, "w " * 200_000, "a"), (2, "x y z", "b"), (3, "", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in M.mix_counts(df).collect()}
    want = brute_targets({"a": 200_000, "b": 3})
    assert got[1].size == 200_000 and abs(got[1].taken - want["a"]) <= M.BLOCK_WORDS and got[1].taken <= 400_000
    assert got[3].taken == 0 and got[2].taken <= 6


def test_permutation_is_one():
    for n in (1, 2, 3, 64, 1000, 4097):
        x = M.permuted(np.arange(n), np.full(n, n), np.full(n, 99, "uint64"))
        assert sorted(x) == list(range(n))


def test_mixed_documents_hold_the_taken_words(spark):
    df = frame(spark).withColumn("n_chars", F.length("text"))
    out = M.mix_documents(df)
    assert out.columns == df.columns
    words = F.sum(F.size(M.word_array(F.col("text")))).alias("n")
    counts = {r.source: r.n for r in out.groupBy("source").agg(words).collect()}
    want = {}
    for r in M.mix_counts(df.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))).join(
            df.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "source").distinct(), "doc_id").groupBy("source").agg(
            F.first("target").alias("t")).collect():
        want[r.source] = r.t
    for s, t in want.items():
        assert abs(counts.get(s, 0) - t) <= M.BLOCK_WORDS
    texts = {r.text for r in df.collect()}
    assert all(any(r.text in t for t in texts if t) or r.text for r in out.collect())


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix_counts(df).count() == 0 and M.mix_documents(df).count() == 0
