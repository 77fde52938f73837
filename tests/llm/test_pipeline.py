"""The pipeline's stages against plain versions, each on its own input."""

import re
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from sparkmend.llm import language_ppm, quality_neighbours, source_mix
from sparkmend.llm.common import BATCH_CONF, fold, table
from sparkmend.session import cut_lineage

sys.path.insert(0, str(Path(__file__).parent))
from test_near_duplicates import brute as brute_components  # noqa: E402
from test_source_mix import brute_targets  # noqa: E402

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output of every stage."""
    docs, out = table(spark, SF, "documents"), {}
    for name, stage in P.STAGES:
        done = cut_lineage(stage(spark, docs, SF), name)
        out[name] = (docs, done)
        docs = done
    return out


def test_columns(spark, steps):
    columns = table(spark, SF, "documents").columns
    for name, (_, done) in list(steps.items())[:-1]:
        assert done.columns == columns, name
    assert steps["pieces"][1].columns[:len(columns)] == columns


def test_quality_and_language_decisions(spark, steps):
    docs, kept = steps["quality"]
    model = quality_neighbours.learn(docs, table(spark, SF, "labels"), allowed=fold(F.col("doc_id"), 4) != 2)
    texts = docs.select("doc_id", "text").collect()
    good = {r.doc_id for r in texts if model.scores(quality_neighbours.term_matrix([(r.text or "").encode()]))[0] >= 0.7}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == good
    labels = table(spark, SF, "labels").where("quality = 1").join(docs, "doc_id")
    assert labels.join(kept, "doc_id", "left_semi").count() >= 0.98 * labels.count()
    docs, kept = steps["language"]
    model = language_ppm.learn(docs, allowed=fold(F.col("doc_id"), 4) != 2)
    rows = docs.select("doc_id", "text").collect()
    found = [model.judge([r.text]) for r in rows]
    want = {r.doc_id for r, (lang, score, *_) in zip(rows, found) if lang[0] != "und" and score[0] >= 0.5}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == want  # none of these is foreign


def test_unlearned_languages_go(spark):
    """Texts of languages without learning rows, and noise, go; every document of the tables stays."""
    docs = table(spark, SF, "documents")
    alien = ["Suomen kieli on uralilainen kieli, jota puhutaan pääasiassa Suomessa, ja se on toinen maan virallisista kielistä. " * 3,
             "Język polski jest językiem z grupy zachodniosłowiańskiej, do której należą również czeski i słowacki. " * 3,
             "日本語は、日本国内や、かつての日本領だった国、そして国外移民を含む日本人同士の間で使用されている言語。", "xq zvk wqj kkpz " * 30]
    short = ["Suomen kieli", "12 345 e"]
    first = docs.agg(F.max("doc_id")).first()[0] + 1
    rows = [(first + i, t) for i, t in enumerate([*alien, *short, None, "..."])]
    more = spark.createDataFrame(rows, "doc_id long, text string").select(
        *[F.col(c) if c in ("doc_id", "text") else F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
    kept = {r.doc_id for r in P.language(spark, docs.unionByName(more), SF).select("doc_id").collect()}
    want = {r.doc_id for r in docs.select("doc_id").where(F.col("text").rlike(r"\p{L}")).collect()}
    assert kept == want | {first + len(alien), first + len(alien) + 1}


def test_one_document_of_each_group_stays(steps):
    docs, kept = steps["near_dedup"]
    groups = brute_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 5)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(i for i, (_, c) in groups.items() if c == i)


def test_sources_reach_their_targets(steps):
    docs, mixed = steps["mix"]
    sizes, taken, of = Counter(), Counter(), Counter()
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
        of[r.doc_id] = len(WORD.findall(r.text or ""))
    per_doc = Counter()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in mixed.collect():
        n = len(WORD.findall(r.text))
        taken[r.source] += n
        per_doc[r.doc_id] += n
        assert r.n_chars == len(r.text)
        if n == of[r.doc_id]:
            assert r.text == texts[r.doc_id]
    for s, t in brute_targets(sizes).items():
        assert abs(taken[s] - t) <= source_mix.BLOCK_WORDS
    assert all(n <= 2 * of[i] for i, n in per_doc.items())


def test_pieces_give_the_texts_back(spark, steps):
    import sentencepiece
    import public_tokenizers
    sp = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    mixed, done = steps["pieces"]
    rows = done.collect()
    assert all(r.lossless and sp.decode(list(r.piece_ids)) == r.text for r in rows)
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in mixed.collect())


def test_run_is_the_stages(spark, steps):
    got = P.run(spark, SF)
    a, b = (Counter((r.doc_id, r.n_pieces) for r in d.select("doc_id", "n_pieces").collect()) for d in (got, steps["pieces"][1]))
    assert a == b


def test_pieces_hold_one_python_process_a_task(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").limit(20)
    plan = P.pieces(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") + plan.count("MapInArrow") == 1


def test_stages_send_small_batches_to_python(spark):
    docs, was = table(spark, "/root/testdata/sf0.001", "documents"), spark.conf.get(BATCH_CONF)
    try:
        for name, stage in P.STAGES[3:]:
            spark.conf.set(BATCH_CONF, "64m")
            stage(spark, docs, SF)
            assert int(spark.conf.get(BATCH_CONF).rstrip("b")) <= 2_000_000, name
        spark.conf.set(BATCH_CONF, "64m")
        most = []
        encode = P.piece_sampling.encode
        P.piece_sampling.encode = lambda *a, **k: most.append(k["batch_chars"]) or encode(*a, **k)
        P.pieces(spark, docs, SF)
        assert most[0] <= 150_000
    finally:
        P.piece_sampling.encode = encode
        spark.conf.set(BATCH_CONF, was)
