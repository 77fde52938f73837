"""SentencePiece encoding by sampled segmentations, and lossless decoding.

The pieces of a ``.model`` file span a lattice over a text: an edge for every piece that matches at a place, and for a
character without a piece of its own an edge of its UTF-8 byte pieces. Pieces hold spaces only at their beginning, so the lattice falls
apart into units: a run of spaces with what follows it. For each distinct unit of a batch the forward filter adds up, over all ways
to each place, the weights of the ways (log-sum-exp); all units take a place side by side. Each occurrence of a unit is
then sampled backwards from its end: an edge is drawn in proportion to the weight of the ways through it. The draws come
from a hash of seed, row key, unit number and step, so a row's segmentation depends on its key and text alone: reruns, other
partitions and lost executors give the same pieces. The weight of the r-th piece is ``r ** -alpha``: larger ``alpha``
favours frequent (longer) pieces, 0 makes all segmentations equally likely.

Decoding joins the pieces' bytes and takes off the space put before the text; it gives every text back exactly. The meta
symbol U+2581 in a text is spelled in byte pieces, so it isn't taken for a space.

Rows are encoded where they are, without a shuffle. Cases: NULL texts give NULL pieces, empty ones none; a NULL key
is a key; repeated rows get the same pieces; very long texts and units only take more steps; an empty table gives an
empty result; other columns stay, and those with the names of the result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmend.llm.common import small_batches
from sparkmend.llm.text_arrays import HashIndex, batches, mixed

META = "▁"
ALPHA = 2.0
SEED = 11
BATCH_CHARS = 500_000  # bytes of text whose lattices a task holds at once, in 200 to 300 times as many bytes
_UNIT = re.compile(r" *[^ ]+| +")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


class Pieces:
    """The pieces of a model file: a hashed prefix tree of their characters, their weights and bytes."""

    def __init__(self, content: bytes, alpha: float = ALPHA) -> None:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=content)
        n = sp.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.byte_id = np.full(256, -1, "int64")
        texts = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.bytes[i] = bytes((int(piece[1:-1], 16),))
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                texts[piece] = i
                self.bytes[i] = piece.replace(META, " ").encode()
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces, so it can't encode every text")
        if any(META in p.lstrip(META) for p in texts):
            raise ValueError("a piece holds a space after other characters")
        rank = np.zeros(n)
        rank[sorted(texts.values())] = np.arange(1, len(texts) + 1)
        self.weight = -alpha * np.log(np.maximum(rank, 1))
        self.spell = -alpha * np.log(len(texts) + 1.0)  # a byte piece
        keys: dict[int, int] = {}
        for p, i in texts.items():
            h = 0
            for k, ch in enumerate(p):
                h = (h * int(_BASE) + ord(ch) + 1) & (2**64 - 1)
                keys[h] = i if k == len(p) - 1 else keys.get(h, -1)
        names = np.fromiter(keys, "uint64", len(keys))
        self.index = HashIndex(mixed(names))
        self.piece_at = np.append(np.fromiter(keys.values(), "int64", len(keys)), -1)
        self.longest = max(map(len, texts))

    def edges(self, cps: np.ndarray, unit_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first character, length, piece) of every edge; a byte edge has piece ``-1 - code point``."""
        at, h = np.arange(len(cps)), np.zeros(len(cps), "uint64")
        out = []
        single = np.zeros(len(cps), bool)
        for length in range(1, self.longest + 1):
            inside = at + length <= unit_end[at]
            at, h = at[inside], h[inside]
            h = h * _BASE + cps[at + length - 1].astype("uint64") + np.uint64(1)
            found = self.index.find(mixed(h))
            piece = self.piece_at[found]
            hit = (found >= 0) & (piece >= 0)
            out.append((at[hit], np.full(int(hit.sum()), length), piece[hit]))
            if length == 1:
                single[at[hit]] = True
            at, h = at[found >= 0], h[found >= 0]
            if not len(at):
                break
        bare = np.flatnonzero(~single)
        out.append((bare, np.ones(len(bare), "int64"), -1 - cps[bare].astype("int64")))
        return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


class Lattice:
    """Forward-filtered lattices of distinct units, ready for backward sampling."""

    def __init__(self, units: list[str], pieces: Pieces) -> None:
        size = np.fromiter(map(len, units), "int64", len(units))
        start = np.cumsum(size) - size
        cps = np.frombuffer("".join(units).encode("utf-32-le"), "<u4")
        cps = np.where(cps == 0x20, ord(META), np.where(cps == ord(META), 0x110000, cps))
        unit = np.repeat(np.arange(len(units)), size)
        first, length, piece = pieces.edges(cps, (start + size)[unit])
        piece = np.where(piece == -1 - 0x110000, -1 - ord(META), piece)
        code = -1 - piece
        spelled = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        weight = np.where(piece >= 0, pieces.weight[np.maximum(piece, 0)], spelled * pieces.spell)
        # a unit of n characters has n + 1 nodes
        source = first + unit[first]
        target = source + length
        place = target - (start + np.arange(len(units)))[unit[first]]
        order = np.argsort(target, kind="stable")  # the same order of edges in every batch
        source, target, weight, piece, place = (x[order] for x in (source, target, weight, piece, place))
        self.source, self.piece = source, piece
        # the forward pass takes the edges by place (small numbers sort by radix), targets in order
        small = place.astype("uint16") if len(place) and place.max() < 65536 else place
        by_place = np.argsort(small, kind="stable")
        source_at, target_at, weight_at = source[by_place], target[by_place], weight[by_place]
        self.forward = np.zeros(len(cps) + len(units))
        cut = np.searchsorted(small[by_place], np.arange(1, int(place.max(initial=0)) + 2))
        for lo, hi in zip(cut[:-1], cut[1:]):
            to = target_at[lo:hi]
            ways = self.forward[source_at[lo:hi]] + weight_at[lo:hi]
            edge = np.flatnonzero(np.diff(to, prepend=-1))
            most = np.maximum.reduceat(ways, edge)
            add = np.add.reduceat(np.exp(ways - np.repeat(most, np.diff(np.append(edge, hi - lo)))), edge)
            self.forward[to[edge]] = most + np.log(add)
        share = np.exp(self.forward[source] + weight - self.forward[target])
        run = np.cumsum(share)
        edge = np.flatnonzero(np.diff(target, prepend=-1))
        many = np.diff(np.append(edge, len(target)))
        up_to = run - np.repeat(run[edge] - share[edge], many)
        self.key = target + np.minimum(up_to, 1.0)
        self.key[edge + many - 1] = target[edge] + 1.0  # the last edge takes what rounding leaves
        self.begin = start + np.arange(len(units))
        self.end = self.begin + size

    def sample(self, unit: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled pieces of unit occurrences, one after the other, and the number of each occurrence's pieces.

        ``draw``: a 64-bit state for each occurrence.
        """
        node, stop = self.end[unit], self.begin[unit]
        live = np.flatnonzero(node > stop)
        count = np.zeros(len(unit), "int64")
        taken = []
        step = 0
        while len(live):
            step += 1
            at = node[live]
            u = (mixed(draw[live] + np.uint64(step)) >> np.uint64(11)).astype("float64") * 2.0**-53
            edge = np.searchsorted(self.key, at + u, "right")
            edge = np.minimum(edge, len(self.key) - 1)
            taken.append((live, self.piece[edge]))
            count[live] += 1
            node[live] = self.source[edge]
            live = live[node[live] > stop[live]]
        out = np.zeros(int(count.sum()), "int64")
        last = np.cumsum(count) - 1
        for k, (who, piece) in enumerate(taken):
            out[last[who] - k] = piece
        return out, count


def encode_batch(texts: list[str], seeds: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, one after the other, and the number of ids of each text."""
    number: dict[str, int] = {}
    unit: list[int] = []
    many = np.zeros(len(texts), "int64")
    for i, t in enumerate(texts):
        found = _UNIT.findall(" " + t) if t else []
        many[i] = len(found)
        unit += [number.setdefault(u, len(number)) for u in found]
    if not unit:
        return np.zeros(0, "int32"), many
    lattice = Lattice(list(number), pieces)
    order = np.arange(len(unit)) - np.repeat(np.cumsum(many) - many, many)
    draw = mixed(np.repeat(seeds.astype("uint64"), many) + order.astype("uint64") * _BASE)
    sampled, count = lattice.sample(np.array(unit), draw)
    # byte edges become their byte pieces
    code = np.maximum(-1 - sampled, 0)
    width = np.where(sampled >= 0, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
    ids = np.repeat(sampled, width)
    bare = np.flatnonzero(sampled < 0)
    if len(bare):
        spelled = np.frombuffer(code[bare].astype("<u4").tobytes().decode("utf-32-le").encode(), "uint8")
        ids[_ragged((np.cumsum(width) - width)[bare], width[bare])] = pieces.byte_id[spelled]
    text_of = np.repeat(np.repeat(np.arange(len(texts)), many), count)
    return ids.astype("int32"), np.bincount(text_of, width, len(texts)).astype("int64")


def decode(ids, pieces: Pieces) -> str:
    """The text of a list of piece ids."""
    table = pieces.bytes
    return b"".join([table[i] for i in ids])[1:].decode()


_LOADED: dict[int, Pieces] = {}


def _loaded(content: bytes, alpha: float) -> Pieces:
    key = hash((content, alpha))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(content, alpha)
    return _LOADED[key]


def encode(docs: DataFrame, model_path: str, *, key: str = "doc_id", text: str = "text", alpha: float = ALPHA,
           seed: int = SEED, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """Add ``piece_ids`` (sampled, array<int>), ``n_pieces`` and ``lossless`` (decoding gave the text back) to every row.

    ``batch_chars``: bytes of text whose lattices a task holds at once; fewer take less memory and more time, the pieces are the same.
    The model file (a fixed size, known before the run) is read on the driver and broadcast.
    """
    small_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    added = ("piece_ids", "n_pieces", "lossless")
    base = docs.select(*[c for c in docs.columns if c not in added])
    schema = T.StructType([*base.schema.fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType())),
                           T.StructField("n_pieces", T.LongType()), T.StructField("lossless", T.BooleanType())])
    at, width = base.columns.index(text), len(base.columns)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _loaded(content.value, alpha)
        for p in parts:
            sizes = np.fromiter((len(t.as_buffer()) if t.is_valid else 0 for t in p.column(at)), "int64", p.num_rows)
            for lo, hi in batches(sizes, batch_chars):
                part = p.slice(lo, hi - lo)
                texts = part.column(at).to_pylist()
                seeds = part.column(width).to_numpy(zero_copy_only=False)
                ids, n = encode_batch([t or "" for t in texts], seeds, pieces)
                offsets = np.concatenate(([0], np.cumsum(n)))
                listed = ids.tolist()
                same = [None if t is None else decode(listed[a:b], pieces) == t
                        for t, a, b in zip(texts, offsets[:-1], offsets[1:])]
                null = np.array([t is None for t in texts])
                arrays = pa.ListArray.from_arrays(pa.array(offsets.astype("int32"), mask=np.append(null, False)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:width], arrays, pa.array(n, mask=null), pa.array(same, pa.bool_())],
                    names=schema.fieldNames())

    return base.withColumn("__seed", F.xxhash64(F.lit(seed), F.col(key))).mapInArrow(run, schema)


def decode_rows(encoded: DataFrame, model_path: str, *, ids: str = "piece_ids", text: str = "text") -> DataFrame:
    """Replace (or add) ``text`` by the decoding of ``ids``; NULL ids give NULL."""
    with open(model_path, "rb") as f:
        content = encoded.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def decoded(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = _loaded(content.value, ALPHA)
        for lists in column:
            yield pd.Series([None if x is None else decode(x, pieces) for x in lists], dtype="object")

    return encoded.withColumn(text, decoded(F.col(ids)))
