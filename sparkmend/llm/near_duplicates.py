"""Near-duplicates by an LSH forest of MinHash signatures, links confirmed on full shingle sets.

1. Every text becomes the set of its ``shingle``-word runs (64-bit hashes), a 128-bit digest of the set and a
   MinHash signature. Texts with equal sets fall into one class, so copies cost no pairs.
2. The forest: tree ``t`` orders the classes by the signature rotated by ``t`` bands. Each order is one range-sorted
   table, so a region with very many similar classes is spread over partitions. Classes that share the first ``depth``
   values are a region; a class's candidates are its ``NEAR`` next neighbours in the order, those with the
   longest common prefix: the depth adapts to how dense the region is, and the work stays linear.
3. Candidates are compared by signature (cut off well below the threshold), then confirmed on the full sets: first
   the one of the longest common prefix of each class. Then the forest of the classes that have candidates is sorted
   again with their components, ``WAVES`` times: neighbours of one component are no candidates any more. In the last
   wave all candidates that are left are compared, in those before it the longest common prefix of each class.
4. Regions larger than the neighbourhood whose classes are still in several components are finished exactly: the classes
   outside the region's largest component are compared with all of the region, in blocks of packed, longer
   signatures, and what passes is confirmed on full sets in the same way. So no cap on neighbours loses a link.

With ``depth`` d and ``trees`` t, two texts of similarity s share no region with probability (1 - s^d)^t: 3e-6 at 0.8 for
the defaults. For far larger tables a deeper and wider forest (8 and 64: 8e-6) keeps chance regions small.

Cases: texts without words (NULL, empty) have an empty set, are linked with nothing and kept; a text with fewer words than a
shingle is one shingle of all its words; NULL ids take part, and never name a component that has another id; repeated rows
fall into one class; an empty table gives an empty result; columns other than key and text play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmend.llm.common import compact, small_batches
from sparkmend.llm.components import components
from sparkmend.llm.text_arrays import Batch, batches, mixed
from sparkmend.session import cut_lineage, release

DEPTH, TREES = 5, 32
NEAR = 2
MARGIN = 0.14  # 4.4 standard deviations of a 160-value estimate at 0.8
WAVES = 2
LONG_VALUES, LONG_MARGIN = 8192, 0.03  # the same (one bit a value) for regions that are finished pair by pair
BLOCK = 64
BATCH_BYTES = 1_000_000


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z lower-cased)."""
    b = Batch([t.lower() for t in texts])
    h = b.hashes()
    run = h.copy()
    for j in range(1, shingle):
        run = mixed(run[:len(h) - j] * np.uint64(0xD1342543DE82EF95) + h[j:])
    out = []
    for lo, hi in zip(b.first[:-1], b.first[1:]):
        if hi - lo >= shingle:
            out.append(np.unique(run[lo:hi - shingle + 1]))
        elif hi > lo:
            whole = np.uint64(hi - lo)
            for x in h[lo:hi]:
                whole = mixed(np.array([whole * np.uint64(0xD1342543DE82EF95) + x]))[0] if shingle > 1 else x
            out.append(np.array([whole], "uint64"))
        else:
            out.append(np.zeros(0, "uint64"))
    return out


def digest(s: np.ndarray) -> bytes | None:
    """128-bit name of a set; None for the empty set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.Philox(key=5))
    return (rng.integers(0, 2**31, n, dtype="uint32") * np.uint32(2) + np.uint32(1))[:, None], rng.integers(0, 2**32, n, dtype="uint32")[:, None]


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of each permutation over the set, shortened to 16 bits."""
    x = (s >> np.uint64(32)).astype("uint32")
    least = np.full(len(a), 0xFFFFFFFF, "uint32")
    for lo in range(0, len(x), 2048):
        np.minimum(least, (a * x[lo:lo + 2048] + b).min(axis=1), out=least)
    # the minimum over a large set is small: mix before shortening
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2")


def _texts(p: pd.DataFrame, text: str) -> list[bytes]:
    return [b"" if t is None else t.encode() for t in p[text]]


def signatures(docs: DataFrame, key: str, text: str, shingle: int, depth: int, trees: int) -> DataFrame:
    """``__k`` (hash of id and text), the key, ``n_shingles``, ``node`` (set digest) and ``sig`` of every row."""
    a, b = _permutations(depth * trees)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            raw = _texts(p, text)
            for lo, hi in batches(np.array([len(t) for t in raw]), BATCH_BYTES):
                sets = shingle_sets(raw[lo:hi], shingle)
                yield pd.DataFrame({
                    "__k": p["__k"].iloc[lo:hi].to_numpy(), key: p[key].iloc[lo:hi].to_numpy(),
                    "n_shingles": np.array([len(s) for s in sets], "int64"), "node": [digest(s) for s in sets],
                    "sig": [signature(s, a, b).tobytes() if len(s) else None for s in sets]})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select("__k", key, text).mapInPandas(
        run, f"`__k` long, `{key}` {kind}, n_shingles long, node binary, sig binary")


def _kept(df: DataFrame, name: str) -> DataFrame:
    """A result that later steps read more than once, in few files."""
    return cut_lineage(compact(df), name)


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of equal widths as a byte matrix."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], "int32")[column.offset:column.offset + n + 1]
    if not n:
        return np.zeros((0, width), "uint8")
    return np.frombuffer(column.buffers()[2], "uint8")[offsets[0]:offsets[-1]].reshape(n, width)


FOREST_OUT = "kind int, tree int, band binary, a binary, b binary, common int"


def _neighbours(band_bytes: int, near: int, comps: bool):
    """Over one range of a sorted forest: pairs of near neighbours (kind 0), the range's first and last
    rows (kind 1), and the members of regions too large for the neighbourhood (kind 2).

    ``comps``: rows carry their component; only pairs of different components come out, and no members.
    """
    def emit(kind, tree, key, a, b=None, common=None):
        n = len(tree)
        flat = lambda m: pa.array([bytes(r) for r in m], pa.binary())
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(n, kind, "int32")), pa.array(tree.astype("int32")), flat(key), flat(a),
            flat(b if b is not None else a), pa.array((common if common is not None else np.zeros(n)).astype("int32"))],
            names=["kind", "tree", "band", "a", "b", "common"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, key, node, comp, fresh = None, None, None, None, 0
        head = []
        for p in parts:
            t, k, v = p.column(0).to_numpy(zero_copy_only=False), _fixed(p.column(1), 16), _fixed(p.column(2), 16)
            c = _fixed(p.column(3), 16) if comps else v
            if not len(t):
                continue
            if tree is None:
                tree, key, node, comp, fresh = t, k, v, c, 0
            else:
                tail = slice(max(0, len(tree) - near - 1), None)
                fresh = len(tree[tail])
                tree, key, node, comp = (np.concatenate([x[tail], y]) for x, y in ((tree, t), (key, k), (node, v), (comp, c)))
            rows = (tree, key, node, comp)
            if len(head) == 0 or len(head[0]) < near + 1:
                first = [x[:near + 1] for x in rows]
                head = first if fresh == 0 else [np.concatenate([h, x[fresh:]])[:near + 1] for h, x in zip(head, rows)]
            for step in range(1, near + (1 if comps else 2)):
                if len(tree) <= step:
                    break
                same = (tree[step:] == tree[:-step]) & (key[step:, :band_bytes] == key[:-step, :band_bytes]).all(1)
                same &= np.arange(step, len(tree)) >= fresh
                if comps:
                    same &= (comp[step:] != comp[:-step]).any(1)
                i = np.flatnonzero(same)
                if not len(i):
                    continue
                if step <= near:
                    alike = key[i + step] == key[i]
                    both = alike[:, 0::2] & alike[:, 1::2]
                    yield emit(0, tree[i], key[i, :band_bytes], node[i], node[i + step], np.cumprod(both, axis=1).sum(1))
                else:  # a run longer than the neighbourhood: its rows, repeats are dropped later
                    j = np.unique((i[:, None] + np.arange(step + 1)).ravel())
                    yield emit(2, tree[j], key[j, :band_bytes], node[j])
        if tree is not None:
            tail = slice(max(0, len(tree) - near - 1), None)
            for t, k, v, c in (head, (tree[tail], key[tail], node[tail], comp[tail])):
                yield emit(1, t, k, v, c)
    return run


def forest(classes: DataFrame, depth: int, trees: int, near: int = NEAR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidate pairs (``a, b, common``), members of large regions (``tree, band, node``), and the table that both read.

    With a column ``comp`` only pairs of different components are candidates, and there are no regions.
    """
    width = 2 * depth
    comp = ["comp"] if "comp" in classes.columns else []
    rows = classes.select("node", *comp, F.concat("sig", "sig").alias("s")).select(
        "node", *comp, "s", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    rows = rows.select("tree", F.expr(f"substring(s, tree * {width} + 1, 16)").alias("key"), "node", *comp)
    spark = classes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = rows.repartitionByRange(parts, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    found = _kept(order.mapInArrow(_neighbours(width, near, bool(comp)), FOREST_OUT), "forest")
    pairs = found.where("kind = 0").select("a", "b", "common")
    # regions that cross the border of two ranges: a few rows a range
    borders = found.where("kind = 1").select(
        "tree", F.col("band").alias("key"), F.substring("band", 1, width).alias("band"), F.col("a").alias("node"),
        F.col("b").alias("comp")).distinct()
    along = Window.orderBy("tree", "key", "node")
    for step in range(1, near + 2):
        nxt = borders.select("tree", "band", F.col("node").alias("a"), "comp", *[
            F.lead(c, step).over(along).alias(n) for c, n in (("node", "b"), ("band", "band2"), ("tree", "tree2"), ("comp", "comp2"))])
        pairs = pairs.union(nxt.where("band = band2 and tree = tree2 and comp <> comp2").select("a", "b", F.lit(depth).alias("common")))
    edge = borders.select("tree", "band", "node")
    large = found.where("kind = 2").select("tree", "band", F.col("a").alias("node")).union(edge).distinct()
    pairs = pairs.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.max("common").alias("common"))
    return pairs, large, found


def estimated(pairs: DataFrame, classes: DataFrame, threshold: float, margin: float = MARGIN) -> DataFrame:
    """Pairs that may reach the threshold by size and by signature: ``a, b, est``."""
    def alike(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                x, y = (np.frombuffer(b"".join(c), "uint16").reshape(len(c), -1) for c in (p.sig_a, p.sig_b))
                est = (x == y).mean(axis=1)
                near = est >= threshold - margin
                yield p.loc[near, ["a", "b"]].assign(est=est[near])

    side = classes.select("node", "sig", "n_shingles")
    both = (pairs.select("a", "b")
            .join(side.toDF("a", "sig_a", "n_a"), "a").join(side.toDF("b", "sig_b", "n_b"), "b")
            .where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")))
    return both.select("a", "b", "sig_a", "sig_b").mapInPandas(alike, "a binary, b binary, est double")


def _shared(percent: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            keep = []
            for x, y in zip(p.set_a, p.set_b):
                u, v = np.frombuffer(x, "uint64"), np.frombuffer(y, "uint64")
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            yield p.loc[keep, ["a", "b"]]
    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (``a, b``) whose full sets reach ``percent`` / 100."""
    full = (pairs.select("a", "b").join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b"))
    return full.mapInPandas(_shared(percent), "a binary, b binary")


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components so far, with the components ``ca, cb``."""
    a = roots.toDF("a", "ca")
    b = roots.toDF("b", "cb")
    return (pairs.join(a, "a", "left").join(b, "b", "left")
            .withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).where("ca <> cb"))


def _best(pairs: DataFrame, *by: Column | str) -> DataFrame:
    """The best pair of each node by the given order."""
    p = F.struct(*by, "a", "b").alias("p")
    ends = pairs.select("a", p).union(pairs.select("b", p))
    return ends.groupBy("a").agg(F.max("p").alias("p")).select("p.a", "p.b").distinct()


def _with_components(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Add ``comp``, the component so far (a class that has no link is its own)."""
    return classes.join(roots.toDF("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _sketched(sets: DataFrame, values: int) -> DataFrame:
    """A longer signature (one bit a value) of each set."""
    a, b = _permutations(values)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"node": p["node"], "long_sig": [
                np.packbits(signature(np.frombuffer(x, "uint64"), a, b) >> 15).tobytes() for x in p["items"]]})
    return sets.mapInPandas(run, "node binary, long_sig binary")


def _open_regions(members: DataFrame) -> DataFrame:
    """Members of the regions that hold several components, with the region's size ``all`` and its largest component ``main``."""
    at = ["tree", "band"]
    sizes = members.groupBy(*at, "comp").agg(F.count("*").alias("n"))
    top = sizes.groupBy(*at).agg(F.sum("n").alias("all"), F.count("*").alias("comps"),
                                 F.max(F.struct("n", "comp")).alias("m")).where("comps > 1")
    return members.join(top.select(*at, "all", F.col("m.comp").alias("main")), at)


def _packed_blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks of the classes outside each region's largest component, blocks of all its classes)."""
    def packed(r: DataFrame) -> DataFrame:
        salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("all") / BLOCK).cast("long"))
        return r.groupBy("tree", "band", salt.alias("salt")).agg(F.collect_list(
            F.struct("node", "comp", "n_shingles", "sig", "long_sig")).alias("rows"))
    return packed(rows.where("comp <> main")), packed(rows)


def _block_pairs(threshold: float, margin: float, depth: int, best: bool):
    """Pairs of two blocks in different components that may reach the threshold, each in the first tree that holds both.

    ``best``: of these, for each class on the left, only the most alike one in each other component.
    """
    def matrix(column, kind):
        return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for r in p.itertuples(index=False):
                tree = r.tree
                x, y = (matrix(c, "uint16").reshape(len(c), -1, depth) for c in (r.sig, r.sig2))
                lx, ly = matrix(r.long_sig, "uint64"), matrix(r.long_sig2, "uint64")
                size, names = np.asarray(r.n_shingles2), [bytes(v) for v in r.node2]
                number = {c: k for k, c in enumerate({bytes(v) for v in (*r.comp, *r.comp2)})}
                own, comps = ([number[bytes(v)] for v in c] for c in (r.comp, r.comp2))
                comps = np.array(comps)
                a, b, est = [], [], []
                for i, (node, n) in enumerate(zip(r.node, r.n_shingles)):
                    j = np.flatnonzero((np.minimum(size, n) >= threshold * np.maximum(size, n)) & (comps != own[i]))
                    if tree:
                        j = j[~(y[j, :tree] == x[i, :tree]).all(axis=2).any(axis=1)]
                    # half of the values that differ have the same bit
                    alike = 1 - np.bitwise_count(ly[j] ^ lx[i]).sum(axis=1) * (2 / LONG_VALUES)
                    j, alike = j[alike >= threshold - margin], alike[alike >= threshold - margin]
                    if best and len(j):
                        up = np.argsort(alike, kind="stable")
                        top = list({comps[j[k]]: k for k in up}.values())
                        j, alike = j[top], alike[top]
                    a += [bytes(node)] * len(j)
                    b += [names[k] for k in j]
                    est += list(alike)
                yield pd.DataFrame({"a": pd.Series(a, dtype="object"), "b": pd.Series(b, dtype="object"),
                                    "est": pd.Series(est, dtype="float64")})
    return run


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", *, shingle: int = 5, percent: int = 80,
                    depth: int = DEPTH, trees: int = TREES, near: int = NEAR) -> DataFrame:
    """``__k``, key, ``n_shingles``, ``component_id`` (smallest id reachable over links) and ``kept`` for every row."""
    small_batches(docs.sparkSession)
    threshold = percent / 100
    keyed = docs.select(F.xxhash64(key, text).alias("__k"), key, text)
    sigs = cut_lineage(signatures(keyed, key, text, shingle, depth, trees), "signatures")
    classes = _kept(sigs.where("node is not null").groupBy("node").agg(
        F.min(key).alias("least"), F.min("__k").alias("rep"), F.first("n_shingles").alias("n_shingles"),
        F.first("sig").alias("sig")), "classes")
    pairs, large, found = forest(classes, depth, trees, near)
    pairs, large = _kept(pairs, "pairs"), _kept(large, "regions")
    release(found)
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(large.select("node")).distinct()
    some = _kept(classes.join(nodes, "node"), "candidates")
    sets = _sets_of(keyed, some.select("node", F.col("rep").alias("__k")), text, shingle)

    def closest(p: DataFrame, wave: int) -> DataFrame:
        return _best(p, "common", F.xxhash64("a", "b", F.lit(wave)).alias("turn"))

    roots = _linked(estimated(closest(pairs, 0), some, threshold), None, sets, percent)
    release(pairs)
    for wave in range(1, WAVES + 1):
        # pairs of different components only: their number falls with the components, it isn't that of all near pairs
        pairs, _, found = forest(_with_components(some, roots), depth, trees, near)
        roots = _linked(estimated(pairs if wave == WAVES else closest(pairs, wave), some, threshold), roots, sets, percent)
        release(found)
    side = None
    for best in (True, False):
        members = _kept(_open_regions(_with_components(large, roots)), "members")
        if side is None:  # the regions that are open later are among these
            side = _kept(some.select("node", "n_shingles", "sig").join(
                _sketched(sets.join(members.select("node").distinct(), "node", "left_semi"), LONG_VALUES), "node"), "sketches")
        outside, everyone = _packed_blocks(members.join(side, "node"))
        fields = ("node", "comp", "n_shingles", "sig", "long_sig")
        rest = (outside.select("tree", "band", *[F.col(f"rows.{f}").alias(f) for f in fields])
                .join(everyone.select("tree", "band", *[F.col(f"rows.{f}").alias(f + "2") for f in fields]), ["tree", "band"])
                .drop("band")
                .mapInPandas(_block_pairs(threshold, LONG_MARGIN, depth, best), "a binary, b binary, est double"))
        rest = _kept(rest.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("est").alias("est")), "rest")
        roots = _linked(_best(rest, "est"), roots, sets, percent)
        if not best:
            roots = _linked(_across(rest, roots), roots, sets, percent)
        release(members, rest)
    return _labelled(sigs, classes, roots, key)


def _linked(pairs: DataFrame, roots: DataFrame | None, sets: DataFrame, percent: int) -> DataFrame:
    """The components (``node, root``) after the pairs that the full sets confirm; ``roots``: those before."""
    links = confirmed(pairs, sets, percent)
    return components(links if roots is None else roots.toDF("a", "b").union(links))


def _sets_of(keyed: DataFrame, wanted: DataFrame, text: str, shingle: int) -> DataFrame:
    """Full sets (packed 64-bit hashes) of the wanted classes, from one of their rows each."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            raw = _texts(p, text)
            for lo, hi in batches(np.array([len(t) for t in raw]), BATCH_BYTES):
                # a row of another class may share the representative's 64-bit name: the digest tells them apart
                found = [(n, s.tobytes()) for n, s in zip(p["node"].iloc[lo:hi], shingle_sets(raw[lo:hi], shingle)) if digest(s) == n]
                yield pd.DataFrame(found, columns=["node", "items"])

    rows = keyed.join(wanted.hint("shuffle_hash"), "__k").select("node", text)
    return _kept(rows.mapInPandas(run, "node binary, items binary").groupBy("node").agg(
        F.first("items").alias("items")), "sets")


def _labelled(sigs: DataFrame, classes: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    of = classes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = of.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = of.join(named, "root").select("node", "component_id")
    out = sigs.select("__k", key, "n_shingles", "node").join(by_node, "node", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", key))
    return out.select("__k", key, "n_shingles", "component_id",
                      F.col(key).eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", *, shingle: int = 5,
                         percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component left (the smallest id; of equal rows one).

    Rows are found again by id and the hash of id and text, so two rows of one hash but other ids are not confused.
    """
    verdict = near_duplicates(docs, key, text, shingle=shingle, percent=percent).where("kept")
    # never NULL, so that the join and the last step are dealt alike and the texts move once
    named = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    verdict = verdict.select("__k", named.alias("__id")).distinct()
    tagged = docs.withColumns({"__k": F.xxhash64(key, text), "__id": named})
    at = ["__k", "__id"]
    return tagged.join(verdict.hint("shuffle_hash"), at, "left_semi").dropDuplicates(at).drop(*at)
