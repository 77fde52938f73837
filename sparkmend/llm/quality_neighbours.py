"""Quality classifier by nearest-neighbour voting over latent-semantic vectors.

A document is a bag of terms in three groups, each scaled to unit length: its words, the shapes of
its text (triples of character classes, runs collapsed), and coarse terms for length, for repeated words and
for words repeated at once. Terms are hashed to fixed dimensions. A bounded sample of
labelled documents gives the inverse document frequencies, the singular vectors (randomised SVD) and the
labelled latent vectors. Those (``sample_rows`` x ``rank`` numbers, a size known beforehand) are broadcast;
every document is then projected and compared with all of them in exact blocked cosine products, and the
labels of its ``neighbours`` nearest are weighted by similarity.

The sample is the ``sample_rows`` labelled rows of smallest id hash. Documents are scored where they
are, without a shuffle, so no source or group of copies can overload a task.

Cases: NULL and empty texts are scored by their (length and repetition) terms; NULL labels are not
learned; several labels of one id count as their smallest; without any label the score is 0.5 everywhere; ties in similarity
go to the smaller position in the sample; an empty table gives an empty result; extra columns stay as
they are, and ``score`` and ``predicted`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmend.llm.common import small_batches
from sparkmend.llm.text_arrays import Batch, batches, mixed

SAMPLE_ROWS = 4096
RANK = 48
NEIGHBOURS = 25
SHARPNESS = 8
WORD_DIMS, SHAPE_DIMS, COARSE_DIMS = 1024, 1024, 64
DIMS = WORD_DIMS + SHAPE_DIMS + COARSE_DIMS
BATCH_BYTES = 2_000_000


def _shape_classes() -> np.ndarray:
    """One class for lower-case letters and bytes above ASCII, one for capitals, one for digits; other bytes are their own."""
    c = np.arange(256, dtype="uint8")
    c[ord("a"):ord("z") + 1] = ord("a")
    c[128:] = ord("a")
    c[ord("A"):ord("Z") + 1] = ord("A")
    c[ord("0"):ord("9") + 1] = ord("0")
    return c


_SHAPE = _shape_classes()


def _counts(rows: np.ndarray, terms: np.ndarray, n: int, dims: int) -> np.ndarray:
    return np.bincount(rows * dims + terms, minlength=n * dims).reshape(n, dims).astype("float32")


def term_matrix(texts: list[bytes]) -> np.ndarray:
    """Damped term counts of each text, a row each (``DIMS`` columns)."""
    n = len(texts)
    b = Batch(texts)
    h = b.hashes()
    words = _counts(b.owner, (h >> np.uint64(54)).astype("int64"), n, WORD_DIMS)
    shape = _SHAPE[b.data]
    new = np.concatenate(([True], shape[1:] != shape[:-1]))
    at = np.flatnonzero(new)
    s = shape[at].astype("uint64")
    triple = mixed((s[:-2] << np.uint64(16)) | (s[1:-1] << np.uint64(8)) | s[2:]) if len(s) > 2 else np.zeros(0, "uint64")
    of = np.searchsorted(b.text_end, at[:-2], "left") if len(s) > 2 else np.zeros(0, "int64")
    shapes = _counts(np.minimum(of, n - 1), (triple >> np.uint64(54)).astype("int64"), n, SHAPE_DIMS)
    # coarse terms: length, share of words said before, share of words equal to the word before
    size = np.diff(b.first)
    order = np.lexsort((h, b.owner))
    again = np.zeros(len(h), bool)
    same = (h[order][1:] == h[order][:-1]) & (b.owner[order][1:] == b.owner[order][:-1])
    again[1:] = same
    seen = np.bincount(b.owner[order][again], minlength=n)
    twin = np.zeros(len(h), bool)
    twin[1:] = (h[1:] == h[:-1]) & (b.owner[1:] == b.owner[:-1])
    twins = np.bincount(b.owner[twin], minlength=n)
    per = np.maximum(size, 1)
    coarse = np.zeros((n, COARSE_DIMS), "float32")
    row = np.arange(n)
    coarse[row, np.minimum(np.log2(size + 1).astype("int64"), 23)] = 1
    coarse[row, 24 + np.minimum((10 * seen / per).astype("int64"), 9)] = 1
    coarse[row, 40 + np.minimum((10 * twins / per).astype("int64"), 9)] = 3
    return np.hstack([np.log1p(words), np.log1p(shapes), coarse])


@dataclass(frozen=True)
class Model:
    """Term weights, latent basis (``DIMS`` x rank), labelled unit vectors and their labels."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, terms: np.ndarray) -> np.ndarray:
        latent = _scaled(terms, self.idf) @ self.basis
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)

    def scores(self, terms: np.ndarray, neighbours: int = NEIGHBOURS, sharpness: int = SHARPNESS) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors."""
        if not len(self.labels):
            return np.full(len(terms), 0.5)
        k = min(neighbours, len(self.labels))
        out = np.empty(len(terms))
        for lo in range(0, len(terms), 512):
            cosine = self.project(terms[lo:lo + 512]) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            w = np.clip(np.take_along_axis(cosine, near, 1).astype("float64"), 1e-6, 1.0) ** sharpness
            out[lo:lo + 512] = (w * self.labels[near]).sum(1) / w.sum(1)
        return np.clip(out, 0.0, 1.0)


def _scaled(terms: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = terms * idf
    for lo, hi in ((0, WORD_DIMS), (WORD_DIMS, WORD_DIMS + SHAPE_DIMS), (WORD_DIMS + SHAPE_DIMS, DIMS)):
        part = x[:, lo:hi]
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12)
    x[:, :WORD_DIMS] *= 0.5
    return x


def fit_model(terms: np.ndarray, labels: np.ndarray, rank: int = RANK) -> Model:
    """Latent-semantic model of a labelled sample: tf-idf, randomised SVD with fixed start, projection."""
    n = len(terms)
    idf = np.ones(DIMS, "float32")
    basis = np.zeros((DIMS, rank), "float32")
    if n:
        idf[:] = np.log((n + 1) / ((terms > 0).sum(0) + 1)) + 1
        idf[WORD_DIMS + SHAPE_DIMS:] = 1
        x = _scaled(terms.copy(), idf)
        q = np.random.Generator(np.random.Philox(key=9)).standard_normal((DIMS, rank + 16)).astype("float32")
        for _ in range(4):
            q, _r = np.linalg.qr(x.T @ (x @ q))
        u, _s, _v = np.linalg.svd((x @ q).T, full_matrices=False)
        basis[:, :min(rank, u.shape[1])] = (q @ u)[:, :rank]
    model = Model(idf, basis, np.zeros((0, rank), "float32"), np.zeros(0))
    return Model(idf, basis, model.project(terms) if n else model.vectors, labels.astype("float64"))


def _as_bytes(column: pd.Series) -> list[bytes]:
    return [b"" if t is None else t.encode() for t in column]


def learn(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality",
          allowed: Column | None = None, sample_rows: int = SAMPLE_ROWS, rank: int = RANK) -> Model:
    """Fit on the ``sample_rows`` labelled rows of smallest id hash (``allowed``: which labels may be learned)."""
    small_batches(docs.sparkSession)
    rows = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    if allowed is not None:
        rows = rows.where(allowed)
    # labels of ids that have no document would shrink the sample
    rows = rows.join(docs.select(key).distinct(), key, "left_semi")
    sample = (rows.groupBy(key).agg(F.min(label).alias("__label"))
              .orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(sample_rows))
    texts = docs.where(F.col(text).isNotNull()).select(key, text).join(F.broadcast(sample), key)

    def terms(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            raw = _as_bytes(p[text])
            for lo, hi in batches(np.array([len(t) for t in raw]), BATCH_BYTES):
                x = term_matrix(raw[lo:hi])
                yield pd.DataFrame({"k": p[key].iloc[lo:hi].astype("string").to_numpy(), "y": p["__label"].iloc[lo:hi].to_numpy("float64"),
                                    "at": [np.flatnonzero(r).astype("int32") for r in x],
                                    "value": [r[r != 0] for r in x]})

    # bounded: sample_rows rows (repeated documents of an id apart) of at most DIMS numbers
    got = texts.mapInPandas(terms, "k string, y double, at array<int>, value array<float>").groupBy("k").agg(
        F.min_by(F.struct("y", "at", "value"), F.struct(F.size("at"), F.hash("at"))).alias("r")).select(
        "k", "r.*").toPandas().sort_values("k", kind="stable")
    x = np.zeros((len(got), DIMS), "float32")
    for i, (at, value) in enumerate(zip(got["at"], got["value"])):
        x[i, np.asarray(at, "int64")] = value
    return fit_model(x, got.y.to_numpy("float64"), rank)


def score(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.7,
          neighbours: int = NEIGHBOURS) -> DataFrame:
    """Add ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from ``threshold`` on)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in column:
            raw = _as_bytes(texts)
            out = np.empty(len(raw))
            for lo, hi in batches(np.array([len(t) + 2000 for t in raw]), BATCH_BYTES):
                out[lo:hi] = m.scores(term_matrix(raw[lo:hi]), neighbours)
            yield pd.Series(out)

    return docs.withColumn("score", scored(F.col(text))).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
