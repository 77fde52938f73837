"""Quality voting: blocked products against a plain vote, held-out accuracy, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from sparkmend.llm import quality_neighbours as Q
from sparkmend.llm.common import fold

SF_MID = "/root/testdata/sf0.01"


def test_votes_equal_a_plain_vote():
    texts = [f"the {w} of words {i}".encode() for i, w in enumerate("red green blue cyan pink".split() * 8)]
    x = Q.term_matrix(texts)
    model = Q.fit_model(x[:30], np.arange(30) % 2, rank=8)
    got = model.scores(x, neighbours=5)
    latent = model.project(x)
    for v, s in zip(latent, got):
        cosine = model.vectors @ v
        near = np.argsort(-cosine, kind="stable")[:5]
        w = np.clip(cosine[near], 1e-6, 1) ** Q.SHARPNESS
        assert abs(s - (w * model.labels[near]).sum() / w.sum()) < 1e-3 or np.isclose(
            cosine[near[-1]], np.sort(cosine)[-6], atol=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    model = Q.learn(docs, labels, allowed=fold(F.col("doc_id"), 4) != 2)
    got = Q.score(docs, model).join(labels, "doc_id").where(fold(F.col("doc_id"), 4) == 2).toPandas()
    assert (got.predicted == got.quality).mean() > 0.95 and got.score.between(0, 1).all()


def test_odd_rows(spark):
    rows = [(1, "good words here", 5), (2, "BAD!! BAD!!", 5), (3, None, 5), (4, "", 5), (5, "x " * 400_000, 5), (1, "good words here", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, predicted int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (None, 1), (99, 1)], "doc_id long, quality int")
    model = Q.learn(df, labels)
    assert len(model.labels) == 2 and sorted(model.labels) == [0.0, 1.0]
    got = Q.score(df, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert {r.predicted for r in got if r.doc_id == 1} == {1} and {r.predicted for r in got if r.doc_id == 2} == {0}
    none = Q.learn(df, labels.limit(0))
    assert {r.score for r in Q.score(df, none).collect()} == {0.5}
    assert Q.score(df.limit(0), model).count() == 0
