"""Hard-negative mining by segment summary filtering.

Every vector is stored with summaries of its segments: the whole vector, 4 segments, 16 segments and so on, each one's mean and deviation
(the length of what is left when the mean is taken off). Over a segment of ``l`` components a product of two vectors lies within
``l * mean * mean`` plus or minus ``deviation * deviation``; sums over the segments bound the score from both sides. Of the rows of a shard, those
whose bounds rule them out go, the next finer level bounds the rest more tightly, and only what is left is scored exactly, in integers.

* Positives: rows of the anchor's label stay while their upper bound reaches the k-th best lower bound.
* Negatives: for each positive, rows of other labels stay while their bounds meet the window that the positive's score sets, and
  while the upper bound reaches the k-th best lower bound among rows that are surely inside. A row goes if it has no positive left.

The segments are cut after a rotation, which leaves products as they are: the principal axes of a bounded sample, strongest first, become
the segment means, coarse to fine, so a level holds as much of a score in its means as it can and leaves little to the deviations. Vectors that spread
alike in all directions gain nothing from this, and nearly all their rows are scored exactly.

Rows are range-partitioned by label into shards of about ``shard_rows``, so an anchor goes for its positives only to shards
that hold its label, for its negatives to those that hold another one. A label with most rows spreads over many shards. Anchors stream
through a shard in blocks, and no more than ``k`` rows a shard come back for each anchor (and positive).

Cases: rows with a NULL id, label or vector, an empty vector, or a NULL or non-finite component take no part; repeated rows (same id, label and
vector) count as one; rows of one id with another label or vector are rows of their own, but rows of an anchor's id are neither its
positives nor its negatives; vectors of different lengths are not compared; ties go to the smaller id; scores beyond 64 bits stop at
their ends; an anchor without positives or negatives gives no row; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmend.llm.common import small_batches
from sparkmend.session import cut_lineage

SHARD_ROWS = 4096
SALTS = 64
SAMPLE_ROWS = 4096
FANOUT = 4  # segments of a level in one segment of the level before
LONGEST = np.iinfo("int64").max


@dataclass(frozen=True)
class Window100:
    """Scores taken for a positive: ``low * positive <= 100 * negative <= high * positive``, in whole hundredths."""

    low: int = 30
    high: int = 90

    def limits(self, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest whole score inside, exactly (Python integers)."""
        p = positive.astype(object)
        return np.array([-(-self.low * x // 100) for x in p], object), np.array([self.high * x // 100 for x in p], object)


def _levels(length: int) -> list[np.ndarray]:
    """Edges of the segments of every level, coarse to fine; those of a level are also edges of the next."""
    out, count = [], 1
    while count < length:
        out.append(np.linspace(0, length, count + 1).astype("int64"))
        count *= FANOUT
    return out


def fitted_rotation(x: np.ndarray) -> np.ndarray:
    """Orthogonal matrix that turns the principal axes of a sample, strongest first, into segment means, coarse to fine."""
    length = x.shape[1]
    steps = [np.eye(length)[:, :0]]
    for edges in _levels(length):
        steps.append(np.repeat(np.eye(len(edges) - 1), np.diff(edges), axis=0))
    basis = np.zeros((length, 0))
    for column in np.hstack([*steps, np.eye(length)]).T:  # orthogonal to all before; what they span already adds nothing
        for _ in range(2):
            column = column - basis @ (basis.T @ column)
        size = np.linalg.norm(column)
        if size > 1e-6:
            basis = np.hstack([basis, (column / size)[:, None]])
    x = x / max(1.0, float(np.abs(x).max(initial=0)))
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    return axes @ basis.T


class Summaries:
    """Segment means and deviations of rotated vectors, coarse to fine."""

    def __init__(self, x: np.ndarray, rotation: np.ndarray) -> None:
        y = x.astype("float64") @ rotation
        self.size = np.sqrt((y * y).sum(axis=1))
        self.levels = []
        for edges in _levels(x.shape[1]):
            sizes = np.diff(edges)
            means = np.add.reduceat(y, edges[:-1], axis=1) / sizes
            rest = y - np.repeat(means, sizes, axis=1)
            # means carry the root of the length, so that their product is the segment's share of the score
            self.levels.append((means * np.sqrt(sizes), np.sqrt(np.add.reduceat(rest * rest, edges[:-1], axis=1))))

    def bounds(self, level: int, rows: np.ndarray, mean: np.ndarray, deviation: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of some rows, widened by more than rounding may take."""
        means, deviations = self.levels[level]
        middle = means[rows] @ mean
        reach = deviations[rows] @ deviation + 1e-9 * size * self.size[rows] + 1e-6
        return middle - reach, middle + reach


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th largest value; minus infinity if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


class Shard:
    """Rows of one shard with their summaries."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, rotation: np.ndarray) -> None:
        self.ids, self.labels, self.x, self.rotation = ids, labels, x, rotation
        self.summaries = Summaries(x, rotation)
        self.largest = float(np.abs(x.astype("float64")).max(initial=0))
        self.scored = 0  # rows scored exactly, of all rows met: what the filter leaves

    def exact(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Whole scores; Python integers where 64 bits may not hold the sums, cut to 64 bits at the end."""
        self.scored += len(rows)
        if self.largest * float(np.abs(anchor.astype("float64")).max(initial=0)) * len(anchor) < 2.0**62:
            return self.x[rows] @ anchor
        sums = self.x[rows].astype(object) @ anchor.astype(object)
        return np.array([max(-LONGEST, min(LONGEST, s)) for s in sums], "int64")

    def _best(self, rows: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((self.ids[rows], -score))[:k]
        return rows[order], score[order]

    def positives(self, anchor_id: int, label: int, anchor: np.ndarray, own: list, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best rows of the label: (row numbers, scores), best first."""
        rows = np.flatnonzero((self.labels == label) & (self.ids != anchor_id))
        for level, (mean, deviation, size) in enumerate(own):
            if len(rows) <= k:
                break
            low, high = self.summaries.bounds(level, rows, mean, deviation, size)
            rows = rows[high >= _kth(low, k)]
        return self._best(rows, self.exact(rows, anchor), k)

    def negatives(self, anchor_id: int, label: int, anchor: np.ndarray, own: list, least: np.ndarray, most: np.ndarray,
                  k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window ``[least, most]`` the ``k`` best rows of other labels inside."""
        rows = np.flatnonzero((self.labels != label) & (self.ids != anchor_id))
        a, b = np.array(least, "float64")[:, None], np.array(most, "float64")[:, None]
        slack = 1e-9 * np.maximum(np.abs(a), np.abs(b)) + 1e-6
        for level, (mean, deviation, size) in enumerate(own):
            low, high = self.summaries.bounds(level, rows, mean, deviation, size)
            maybe = (high >= a - slack) & (low <= b + slack)
            sure = (low >= a + slack) & (high <= b - slack)
            edge = np.array([_kth(low[s], k) for s in sure])[:, None]
            rows = rows[(maybe & (high >= edge)).any(axis=0)]
        score = self.exact(rows, anchor)
        out = []
        for lo, hi in zip(least, most):
            inside = (score >= lo) & (score <= hi)
            out.append(self._best(rows[inside], score[inside], k))
        return out


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), "int64").reshape(len(vectors), -1)


def _in_shards(parts: Iterator[pd.DataFrame], rotations: dict[int, np.ndarray]) -> Iterator[tuple[Shard, pd.DataFrame]]:
    """(shard, block of anchors) from rows sorted by shard, index rows first."""
    def pieces() -> Iterator[tuple[tuple, pd.DataFrame]]:
        for p in parts:
            for (part, length, kind), piece in p.groupby(["part", "length", "kind"], sort=True):
                yield ((part, length), kind), piece

    shard, number = None, None
    for (at, kind), group in groupby(pieces(), key=lambda x: x[0]):
        if kind == 0:
            held = pd.concat([p for _, p in group])
            shard, number = Shard(held.id.to_numpy("int64"), held.label.to_numpy("int64"), _matrix(held.v), rotations[at[1]]), at
        elif number == at:
            for _, block in group:
                yield shard, block


def _anchors(block: pd.DataFrame, rotation: np.ndarray) -> Iterator[tuple]:
    """(row, vector, its summaries by level) of each anchor of a block."""
    x = _matrix(block.v)
    own = Summaries(x, rotation)
    for i, r in enumerate(block.itertuples(index=False)):
        yield r, x[i], [(m[i], d[i], own.size[i]) for m, d in own.levels]


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def mine(vectors: DataFrame, anchors: Column, *, key: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5,
         negatives: int = 10, window: Window100 = Window100(), scale: int = 256, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: hard negatives of the rows that ``anchors`` selects.

    Components become ``floor(scale * x)``; ``anchors`` may use the columns of ``vectors``.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                          F.col(vector).cast("array<double>").alias("v"), F.coalesce(anchors, F.lit(False)).alias("asked"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("v")))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale))).groupBy("id", "label", "v").agg(F.max("asked").alias("asked"))
    rows = cut_lineage(rows.withColumns({"length": F.size("v"), "row_key": F.xxhash64("id", "label", "v")}), "vectors")
    lengths = {r.length: r["count"] for r in rows.groupBy("length").count().collect()}  # one row a vector length
    rotations = {}
    for length in lengths:  # a bounded sample, by row hash
        sample = rows.where(F.col("length") == length).orderBy("row_key", "id").limit(SAMPLE_ROWS).select("v").toPandas()
        rotations[length] = fitted_rotation(_matrix(sample.v).astype("float64"))
    shared = spark.sparkContext.broadcast(rotations)
    shards = max(1, -(-sum(lengths.values()) // shard_rows))
    # a shard is a range partition's rows of one vector length
    index = cut_lineage(rows.repartitionByRange(shards, "length", "label", "row_key").withColumn("part", F.spark_partition_id()), "shards")
    held = index.select("part", "length", F.lit(0).alias("kind"), "id", "label", "v", F.lit(0).cast("long").alias("row_key"),
                        F.lit(None).cast("array<long>").alias("scores"))
    asked = rows.where("asked").drop("asked")

    def dealt(queries: DataFrame) -> DataFrame:
        both = held.union(queries.select("part", "length", F.lit(1).alias("kind"), "id", "label", "v", "row_key", "scores"))
        return both.repartition(2 * shards, "part", "length").sortWithinPartitions("part", "length", "kind")

    def find_positives(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shard, block in _in_shards(parts, shared.value):
            found = [(r, *shard.positives(r.id, r.label, x, levels, positives)) for r, x, levels in _anchors(block, shard.rotation)]
            times = [len(row) for _, row, _ in found]
            yield pd.DataFrame({"anchor_id": np.repeat([r.id for r, _, _ in found], times), "row_key": np.repeat([r.row_key for r, _, _ in found], times),
                                "positive_id": shard.ids[np.concatenate([row for _, row, _ in found])], "positive_score": np.concatenate([s for _, _, s in found])})

    # a label's shards lie side by side: its first and last range partition, a row for each salt, so that no label is one hot join key
    spans = index.groupBy("length", "label").agg(F.min("part").alias("first"), F.max("part").alias("last")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    near = asked.withColumns({"salt": F.pmod("row_key", F.lit(SALTS)).cast("int"), "scores": F.lit(None).cast("array<long>")}).join(
        spans, ["length", "label", "salt"]).withColumn("part", F.explode(F.sequence("first", "last")))
    near = dealt(near).mapInPandas(find_positives, "anchor_id long, row_key long, positive_id long, positive_score long")
    best = Window.partitionBy("anchor_id", "row_key").orderBy(F.col("positive_score").desc(), "positive_id")
    near = cut_lineage(near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives), "positives")

    def find_negatives(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shard, block in _in_shards(parts, shared.value):
            found = []
            for r, x, levels in _anchors(block, shard.rotation):
                least, most = window.limits(np.asarray(r.scores, "int64"))
                got = shard.negatives(r.id, r.label, x, levels, least, most, negatives)
                found += [(r, place, row, score) for place, (row, score) in enumerate(got, 1)]
            times = [len(row) for _, _, row, _ in found]
            yield pd.DataFrame({"anchor_id": np.repeat([r.id for r, *_ in found], times), "row_key": np.repeat([r.row_key for r, *_ in found], times),
                                "place": np.repeat([place for _, place, _, _ in found], times),
                                "negative_id": shard.ids[np.concatenate([row for *_, row, _ in found])], "negative_score": np.concatenate([s for *_, s in found])})

    # the positives' scores go with the anchor, best first; those below zero, whose window is empty, only keep their place
    scored = near.groupBy(F.col("anchor_id").alias("id"), "row_key").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "positive_score"))), lambda s: s["positive_score"]).alias("scores"))
    # the shards that hold another label than the anchor's; joined by shard, so the work is spread over as many keys
    labels = index.groupBy("part", "length").agg(F.min("label").alias("a"), F.max("label").alias("b"))
    parts = (index.agg(F.max("part")).first()[0] or 0) + 1
    wide = asked.join(scored, ["id", "row_key"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(
        labels, ["part", "length"]).where((F.col("a") != F.col("label")) | (F.col("b") != F.col("label")))
    hard = dealt(wide).mapInPandas(find_negatives, "anchor_id long, row_key long, place int, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "row_key", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return hard.join(near, ["anchor_id", "row_key", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
