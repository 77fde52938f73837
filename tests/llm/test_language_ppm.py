"""Language identification: tables against a plain PPM, held-out accuracy, odd rows."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from sparkmend.llm import language_ppm as L
from sparkmend.llm.common import fold

SF_MID = "/root/testdata/sf0.01"


def brute_log_probability(counts, context, byte):
    """counts[order][context][byte]; method C escapes, no exclusion, smoothed order 0."""
    paid = 0.0
    for order in range(len(context), 0, -1):
        followers = counts[order].get(bytes(context[len(context) - order:]))
        if followers:
            total, kinds = sum(followers.values()), len(followers)
            if followers[byte]:
                return paid + math.log(followers[byte] / (total + kinds))
            paid += math.log(kinds / (total + kinds))
    zero = counts[0][b""]
    return paid + math.log((zero[byte] + 1) / (sum(zero.values()) + 256))


def test_tables_equal_a_plain_ppm():
    rng = random.Random(4)
    texts = {0: ["".join(rng.choice("abcd ") for _ in range(300)).encode()], 1: ["".join(rng.choice("cdeé ") for _ in range(300)).encode()]}
    plain, rows = {}, []
    for lang, raw in texts.items():
        counts = [defaultdict(Counter) for _ in range(L.ORDER + 1)]
        for t in raw:
            for i, b in enumerate(t):
                for k in range(min(i, L.ORDER) + 1):
                    counts[k][t[i - k:i]][b] += 1
        plain[lang] = counts
        data, _, depth = L._batch(raw)
        for k in range(L.ORDER + 1):
            code, n = np.unique(L._grams(data, k)[depth >= k], return_counts=True)
            rows += [(k, c, lang, m) for c, m in zip(code, n)]
    o, c, l, n = map(np.array, zip(*rows))
    model = L.compile_model(["x", "y"], o, c.astype("uint64"), l, n.astype(float))
    probe = [b"abcabc dcd", "décé x\x00".encode(), b"a"]
    data, start, depth = L._batch(probe)
    got = model.log_probabilities(data, depth)
    at = 0
    for t in probe:
        for i, b in enumerate(t):
            for lang in (0, 1):
                want = brute_log_probability(plain[lang], t[max(0, i - L.ORDER):i], b)
                assert abs(got[at, lang] - want) < 1e-4
            at += 1


def test_hash_index():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**62, 5000, dtype="uint64"))
    index = L.HashIndex(keys)
    assert (index.find(keys) == np.arange(len(keys))).all()
    assert (index.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()
    assert (L.HashIndex(keys[:0]).find(keys[:3]) == -1).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    model = L.learn(docs, allowed=fold(F.col("doc_id"), 4) != 2)
    got = L.identify(docs, model).where(fold(F.col("doc_id"), 4) == 2).toPandas()
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id)
    assert (got.lang == got.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()


def test_a_text_is_learned_once_and_the_sample_is_bounded(spark):
    rows = [(i, f"text number {i} of many", "en") for i in range(400)] + [(7, "always the same", "en")] * 500 + [(9, "la maison", "fr")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = Counter((r.lang, r.text) for r in L.sampled(df, "text", "lang", 50).collect())
    assert set(got.values()) == {1}
    assert Counter(lang for lang, _ in got) == {"en": 50, "fr": 1}
    hashes = {r.text: r.h for r in df.select("text", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("h")).distinct().collect()}
    want = sorted((t for t in hashes if t != "la maison"), key=hashes.get)[:50]
    assert {t for lang, t in got if lang == "en"} == set(want)
    everything = L.sampled(df, "text", "lang", 1000).count()
    assert everything == 402


def test_rare_language_keeps_deep_contexts(spark):
    """A language that is a hundredth of the rows keeps its share of the nodes beside a large one."""
    rng = random.Random(8)
    large = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(400)) for _ in range(300)]
    rows = [(i, t, "xx") for i, t in enumerate(large)] + [(1000 + i, "la maison est grande " * 5, "fr") for i in range(3)]
    df = spark.createDataFrame([(i, t + str(i), lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    model = L.learn(df, max_nodes=400)
    fr = model.languages.index("fr")
    deep = int.from_bytes(b"maiso", "big")
    keys, table = model.pairs[3]
    assert deep in keys.tolist() and table[keys.tolist().index(deep), fr] > math.log(0.5)
    for keys, _ in model.pairs:
        assert len(keys) <= 400


def test_code_length_of_plain_words(spark):
    """Letter bytes and their code length, against one text at a time; long texts in slices count alike."""
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    model = L.learn(docs)
    texts = [r.text for r in docs.select("text").limit(40).collect()] + ["Key = a1b2c3 mail@x.org la casa", "123 e"]
    _, _, bits, letters = model.judge(texts)
    for t, b, n in zip(texts, bits, letters):
        words = re.split(r"[ \t\n\x0b\x0c\r]", t.lower())
        plain = [w for w in words if not re.search(r"[0-9@/=_\\]", w)]
        assert n == sum(len(re.sub(rb"[\x00-\x60\x7b-\x7f]", b"", w.encode())) for w in plain)
        one = model.judge([t])
        assert abs(one[2][0] - b) < 1e-2 * max(1, b) and one[3][0] == n
    long = "la casa es grande y bonita " * 100_000
    found, _, bits, letters = model.judge([long])
    assert letters[0] == 21 * 100_000 and bits[0] > 0


def test_odd_rows(spark):
    rows = [(1, "la maison est la", "fr"), (2, "la maison est la", "fr"), (3, "the house is the", "en"), (4, None, "en"),
            (5, "", "fr"), (6, "12 !!", None), (7, "the house", None), (7, "the house", None), (8, "la " * 900_000, None)]
    df = spark.createDataFrame([r + (1.0,) for r in rows], "doc_id long, text string, lang string, score double")
    model = L.learn(df)
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(df, model).collect()}
    assert got[4] == got[5] == got[6] == ("und", 0.0)
    assert got[7][0] == "en" and got[8][0] == "fr" and got[1][0] == "fr"
    nothing = L.learn(df.where("lang = 'xx'"))
    assert {r.lang_pred for r in L.identify(df, nothing).collect()} == {"und"}
    assert L.identify(df.limit(0), model).count() == 0


def test_all_texts_are_learned_on_request(spark):
    """Without a bound every different text counts, each once."""
    rows = [(i, f"text number {i}", "en") for i in range(L.ROWS_PER_LANGUAGE + 200)] + [(9, "the same", "en")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = Counter(r.text for r in L.sampled(df, "text", "lang", None).collect())
    assert set(got.values()) == {1} and len(got) == L.ROWS_PER_LANGUAGE + 201
    n = {(r.gram_order, r.code): r.n for r in L.gram_counts(L.sampled(df, "text", "lang", None), "text", "lang").where("gram_order = 0").collect()}
    assert n[0, ord("x")] == L.ROWS_PER_LANGUAGE + 200
    assert L.learn(df, rows_per_language=None).languages == ["en"]


def test_the_pipeline_learns_from_all_texts(spark, monkeypatch):
    import corpus_pipeline
    seen = []
    real = L.sampled
    monkeypatch.setattr(L, "sampled", lambda rows, text, language, many: seen.append(many) or real(rows, text, language, many))
    docs = spark.createDataFrame([(i, f"the house number {i}", "en") for i in range(40)], "doc_id long, text string, lang string")
    corpus_pipeline.language(spark, docs, "").count()
    assert seen == [None, None]


def test_judging_takes_bounded_memory():
    rng = random.Random(6)
    rows = []
    for lang in range(4):
        data, _, depth = L._batch([bytes(rng.choices(b"abcdefgh ", k=4000))])
        rows += [(k, c, lang, 2.0) for k in range(L.ORDER + 1) for c in np.unique(L._grams(data, k)[depth >= k])]
    o, c, l, n = map(np.array, zip(*rows))
    model = L.compile_model(["a", "b", "c", "d"], o, c.astype("uint64"), l, n)
    texts = ["".join(rng.choices("abcdefgh ", k=4000)) for _ in range(600)]
    whole = [model.judge([t]) for t in texts[:5]]
    tracemalloc.start()
    found, score, *_ = model.judge(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 120e6
    assert [w[0][0] for w in whole] == found[:5] and np.allclose([w[1][0] for w in whole], score[:5])


def test_filters_do_not_judge_texts_twice(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text", "lang")
    known = L.identify(docs, L.learn(docs.limit(200))).where((F.col("lang_pred") == F.col("lang")) & (F.col("letter_bytes") > 0))
    usual = known.groupBy("lang_pred").agg(F.median(F.col("letter_bits") / F.col("letter_bytes")).alias("usual"))
    assert usual._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
