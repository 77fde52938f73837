"""Near-duplicates against brute force over all pairs; stars and chains of components; odd rows."""

import random
import re
from collections import defaultdict

import numpy as np

from sparkmend.llm import near_duplicates as N
from sparkmend.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")))
    if not ws:
        return frozenset()
    return frozenset([tuple(ws)]) if len(ws) < k else frozenset(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))


def brute(rows, k, percent=80):
    """{id: (set size, component)} by union-find over every pair that shares a shingle."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    at = defaultdict(list)
    for j, (_, s) in enumerate(sets):
        for x in s:
            at[x].append(j)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for j, (_, s) in enumerate(sets):
        near = defaultdict(int)
        for x in s:
            for o in at[x]:
                if o > j:
                    near[o] += 1
        for o, n in near.items():
            if 100 * n >= percent * (len(s) + len(sets[o][1]) - n):
                root[find(o)] = find(j)
    least = defaultdict(lambda: 10**18)
    for j, (i, _) in enumerate(sets):
        least[find(j)] = min(least[find(j)], i)
    return {i: (len(s), least[find(j)]) for j, (i, s) in enumerate(sets)}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    texts = [None, "", " \n", "one", "One", "two words", "TWO words", "a b c", "solo é"]
    for g in range(40):  # groups with edits around the threshold
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 200))]
        texts += [edited(rng, base, rng.randint(0, max(1, len(base) // 9))) for _ in range(rng.randint(1, 6))]
    base = [rng.choice(vocab) for _ in range(120)]
    texts += [edited(rng, base, rng.randint(0, 14)) for _ in range(250)]  # one large region, many pairs below 0.8
    texts += [" ".join(base)] * 300  # one large group of copies
    boiler = " ".join(rng.choice(vocab) for _ in range(60))
    texts += [boiler + " " + " ".join(rng.choice(vocab) for _ in range(18)) for _ in range(120)]  # alike, not linked
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_components_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_shingles string")
    for k in (2, 5):
        want = brute(rows, k)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df, shingle=k).collect()}
        assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_stars_and_chains(spark):
    rng = np.random.default_rng(2)
    name = lambda i: int(i).to_bytes(16, "big")
    edges = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5400)] + [(9000, 9000)]
    rng.shuffle(edges)
    df = spark.createDataFrame([(name(a), name(b)) for a, b in edges], "a binary, b binary").repartition(16)
    got = {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in components(df).collect()}
    assert got == {i: 0 for i in range(1, 3000)} | {i: 5000 for i in range(5001, 5401)}
    assert components(df.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    rows = [(5, "a b c d e f g", "en"), (3, "a b c d e f g", "de"), (3, "a b c d e f g", "de"), (9, "h i j k l m", None),
            (None, "z y x w v u", "en"), (10, None, "en"), (11, "", "en"), (12, "long " * 50_000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = N.drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted([r.doc_id for r in got.collect()], key=str) == sorted([3, 9, None, 10, 11, 12], key=str)
    assert N.drop_near_duplicates(df.limit(0)).count() == 0
