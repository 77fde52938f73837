"""Approximate nearest neighbours by a hash-prefix forest, for the largest inner product.

A tree gives every vector a long hash string: the signs of its products with random hyperplanes, after the step that turns
inner products into cosines (a last component fills all vectors up to the largest norm; queries get 0 there). A tree is the
sorted array of these strings. A query descends in all trees to its longest matching prefix, a range of the sorted
array; while the ranges hold too few rows, or fewer than ``k`` different candidates, all trees ascend by one bit at the same
time, up to the whole shard. All rows of the ranges are then scored exactly on the original vectors, so a query gets ``k`` rows
wherever there are as many candidates.

Equal rows (same id and vector) are counted before they move: a query row is answered once and its answer repeated for each
copy, and of a candidate no more than ``k`` copies can be among the ``k`` best, so only so many are kept. The index is split into
shards of about ``shard_rows`` rows by a hash of id and vector, each with its own forest, so a vector that occurs under many ids, an id
with many vectors, or a dense region is spread over all shards. Queries go to the shards in blocks, and only the ``k`` best of
a shard come back. How far to ascend (``visits``, ranges together over rows) is fitted on a bounded sample against brute
force, for a recall of ``target``; neighbours in the whole table are nearer than in a sample, so they are found more easily.
Vectors without any structure (independent in all directions) make it visit most rows; clustered ones few.

Cases: NULL, empty and zero vectors and those with NULL or non-finite components take no part, neither do rows without id; vectors of
different lengths are not compared; ties go to the smaller id; rows with the query's id are its own and no candidates; repeated
rows of another id count each; repeated rows of a query id are each answered in full, as rows of their own; an empty table, and one without queries, gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmend.llm.common import small_batches
from sparkmend.session import cut_lineage

TREES, BITS = 32, 32
SHARD_ROWS = 4096
QUERY_ROWS = 512
SAMPLE_ROWS, SAMPLE_QUERIES = 4096, 128
COPIES = 1000  # copies of an answer written by one task row
TARGET = 0.95
GRID = (0.03, 0.06, 0.125, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, float(TREES))


@dataclass(frozen=True)
class Planes:
    """Hyperplanes of all trees for vectors of one length, and the largest norm."""

    normals: np.ndarray
    largest: float

    @classmethod
    def drawn(cls, length: int, largest: float, trees: int = TREES, bits: int = BITS) -> Planes:
        rng = np.random.Generator(np.random.Philox(key=length))
        return cls(rng.standard_normal((length + 1, trees * bits)), largest)

    def strings(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Hash strings (``BITS`` bits in a 64-bit number), a row for each tree."""
        fill = np.zeros((len(x), 1)) if query else np.sqrt(np.maximum(self.largest**2 - (x * x).sum(1, keepdims=True), 0))
        bits = (np.hstack([x, fill]) @ self.normals > 0).reshape(len(x), -1, BITS)
        return (bits.astype("uint64") << np.arange(BITS - 1, -1, -1, dtype="uint64")).sum(axis=2, dtype="uint64").T


class Forest:
    """Sorted hash strings of one shard, and its vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, planes: Planes) -> None:
        self.ids, self.x, self.planes = ids, x, planes
        strings = planes.strings(x, query=False)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=1)

    def spans(self, strings: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Range of each query in each tree at one depth."""
        rest = np.uint64(BITS - depth)
        low = (strings >> rest) << rest
        return tuple(np.stack([np.searchsorted(s, v, "left") for s, v in zip(self.sorted, edge)])
                     for edge in (low, low + (np.uint64(1) << rest)))

    def ranges(self, strings: np.ndarray, visits: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Range of each query in each tree, and its depth: the deepest common one whose ranges hold ``visits`` x rows together."""
        trees, n = strings.shape
        lo, hi = np.zeros((trees, n), "int64"), np.full((trees, n), len(self.ids))
        deepest = np.zeros(n, "int64")
        todo = np.arange(n)
        for depth in range(1, BITS + 1):
            a, b = self.spans(strings[:, todo], depth)
            stay = (b - a).sum(axis=0) >= visits * len(self.ids)
            lo[:, todo[stay]], hi[:, todo[stay]] = a[:, stay], b[:, stay]
            todo = todo[stay]
            deepest[todo] = depth
            if not len(todo):
                break
        return lo, hi, deepest

    def candidates(self, lo: np.ndarray, hi: np.ndarray, query_id: int) -> np.ndarray:
        """Rows of the ranges of one query, each once, without those of its own id."""
        mark = np.zeros(len(self.ids), bool)
        for order, a, b in zip(self.order, lo, hi):
            mark[order[a:b]] = True
        return np.flatnonzero(mark & (self.ids != query_id))

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, visits: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, row number, score) of the ``k`` best found of each query; ties to the smaller id."""
        strings = self.planes.strings(q, query=True)
        lo, hi, deepest = self.ranges(strings, visits)
        close = q @ self.x.T
        who, row, score = [], [], []
        for j in range(len(q)):
            found = self.candidates(lo[:, j], hi[:, j], query_ids[j])
            depth = deepest[j]
            while len(found) < k and depth > 0:  # too few different ones: go on, up to the whole shard
                depth -= 1
                a, b = self.spans(strings[:, [j]], int(depth))
                found = self.candidates(a[:, 0], b[:, 0], query_ids[j])
            if len(found) > k:
                s = close[j, found]
                edge = np.partition(s, len(s) - k)[len(s) - k]
                found = found[s >= edge - 1e-9 * max(1.0, abs(edge))]
            exact = (self.x[found] * q[j]).sum(axis=1)  # row by row alike, so that equal vectors tie
            best = np.lexsort((self.ids[found], -exact))[:k]
            who.append(np.full(len(best), j))
            row.append(found[best])
            score.append(exact[best])
        return tuple(np.concatenate(v) if v else np.zeros(0) for v in (who, row, score))


def fitted_visits(x: np.ndarray, planes: Planes, k: int, target: float) -> float:
    """Smallest ``visits`` whose recall on a sample (against brute force) reaches the target."""
    ids = np.arange(len(x))
    forest = Forest(ids, x, planes)
    asked = ids[:SAMPLE_QUERIES]
    truth, found, _ = forest.search(asked, x[asked], k, float(planes.normals.shape[1]))
    want = set(zip(truth.tolist(), found.tolist()))
    for visits in GRID:
        a, b, _ = forest.search(asked, x[asked], k, visits)
        if len(want & set(zip(a.tolist(), b.tolist()))) >= target * len(want):
            return visits
    return float(planes.normals.shape[1])


def usable(vector: Column) -> Column:
    """A vector that takes part: some components, all finite, not all zero."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def _blocks(rows: DataFrame, many: Column, name: str) -> DataFrame:
    """Rows packed by length and row hash: ``length``, ``name`` (block number), ids, row keys and flattened vectors."""
    block = F.pmod(F.xxhash64("row_key", F.lit(name)), many).cast("int")
    return (rows.groupBy("length", block.alias(name))
            .agg(F.sort_array(F.collect_list(F.struct("id", "v", "row_key"))).alias("r"))
            .select("length", name, F.col("r.id").alias("ids"), F.col("r.row_key").alias("keys"), F.flatten("r.v").alias("values")))


def nearest(vectors: DataFrame, queries: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = 20,
            shard_rows: int = SHARD_ROWS, target: float = TARGET, visits: float | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row that ``queries`` selects, among all rows."""
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"),
                          F.coalesce(queries, F.lit(False)).alias("asked")).where(F.col("id").isNotNull() & usable(F.col("v")))
    # equal rows as one, with the number of them and of those that ask
    rows = rows.groupBy("id", "v").agg(F.count("*").alias("copies"), F.count_if("asked").alias("times"))
    rows = cut_lineage(rows.withColumns({"length": F.size("v"), "row_key": F.xxhash64("id", "v")}), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    # one row a vector length
    facts = {r.length: r for r in rows.groupBy("length").agg(
        F.sum(F.least("copies", F.lit(k))).alias("n"), F.count_if(F.col("times") > 0).alias("n_asked"), F.max(norm).alias("largest")).collect()}
    planes, fitted = {}, {}
    for length, r in facts.items():
        planes[length] = Planes.drawn(length, float(r.largest))
        # a bounded sample, by row hash
        sample = rows.where(F.col("length") == length).orderBy("row_key", "id").limit(SAMPLE_ROWS).select("v").toPandas()
        fitted[length] = visits if visits is not None else fitted_visits(
            np.array(sample.v.tolist(), "float64").reshape(-1, length), planes[length], k, target)
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast((planes, fitted))
    sizes = spark.createDataFrame(
        [(n, -(-r.n // shard_rows), max(1, -(-r.n_asked // QUERY_ROWS))) for n, r in facts.items()],
        "length int, shards int, parts int")
    rows = rows.join(F.broadcast(sizes), "length")
    kept = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))))
    index = _blocks(kept, F.col("shards"), "shard").drop("keys")
    asked = _blocks(rows.where("times > 0"), F.col("parts"), "part").join(F.broadcast(sizes), "length")
    asked = asked.select("length", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"),
                         F.col("ids").alias("query_ids"), F.col("keys").alias("query_keys"), F.col("values").alias("query_values"))

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes, fitted = shared.value
        for p in parts:
            for r in p.itertuples(index=False):
                ids, q_ids, keys = np.asarray(r.ids), np.asarray(r.query_ids), np.asarray(r.query_keys)
                forest = Forest(ids, np.asarray(r.values, "float64").reshape(-1, r.length), planes[r.length])
                q = np.asarray(r.query_values, "float64").reshape(-1, r.length)
                who, row, score = forest.search(q_ids, q, k, fitted[r.length])
                who = who.astype("int64")
                yield pd.DataFrame({"query_id": q_ids[who], "row_key": keys[who], "vec_id": ids[row.astype("int64")], "score": score})

    found = asked.join(index.hint("merge"), ["length", "shard"]).select(
        "length", "ids", "values", "query_ids", "query_keys", "query_values").mapInPandas(
            search, "query_id long, row_key long, vec_id long, score double")
    best = Window.partitionBy("query_id", "row_key").orderBy(F.col("score").desc(), F.col("vec_id"))
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    # the answer once more for each further copy of a query row, many copies in parts
    more = rows.where("times > 1").select(F.col("id").alias("query_id"), "row_key", F.explode(
        F.sequence(F.lit(1), F.col("times") - 1, F.lit(COPIES))).alias("first"), "times")
    more = found.join(more, ["query_id", "row_key"]).repartition("query_id", "row_key", "rank", "first").withColumn(
        "copy", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + COPIES, F.col("times")) - 1)))
    columns = ["query_id", "rank", "vec_id", "score"]
    return found.select(columns).union(more.select(columns))
