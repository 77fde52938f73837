"""Mixing sources to target weights by packed blocks.

The words of a source form one stream (documents in a hashed order), cut into blocks of
``block_words`` words. A source's target in words becomes a number of slots, one block each.
Slots are dealt to output shards: for each source a multinomial draw over the shards, made by
recursive binomial splitting, so that every run of shards finds its own counts and slot numbers
without a pass over the others; a source has rows for the shards that it has slots in, not for all. Slot ``j`` of a source holds block ``perm_e(j mod n)`` with
``e = j div n``, where ``perm_e`` is a pseudorandom permutation (a keyed Feistel network) of the
source's ``n`` block numbers: every block is used once before any is used again, and a target of
at most twice the size uses no block more than twice. Blocks then meet their slots in an
equi-join on (source, block).

Scale: a document's place in the stream is a running sum inside (source, bucket) plus the sum
of the buckets before it, so a source with a third of all rows is spread over ``BUCKETS``
tasks; nothing is collected, and the joins are on (source, block), one key a block.

Cases: a NULL or empty text has size 0 and is taken 0 times; a NULL source is a source of its
own, last in order; a source without words has target 0; repeated rows each get their own
place in the stream; an empty table gives an empty result; extra columns do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmend.llm.common import word_array
from sparkmend.session import cut_lineage

BLOCK_WORDS = 64
SLOTS_PER_SHARD = 16_384
SLOTS_A_ROW, SLOTS_A_TASK = 4096, 1 << 17
BUCKETS = 4096
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2
SEED = 17


def source_targets(sized: DataFrame, *, weights=WEIGHTS, share: float = SHARE,
                   max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: ``source, source_no, source_size, target``.

    Sources in code-point order (NULL last) get the weights in turn and share ``share`` times all
    words; a target stops at ``max_repeats`` times the source's size and the excess is shared again
    by weight. With sources ordered by cap / weight, the capped ones are a prefix of that order, so
    the level at which the rest share is found from running sums (one row per source).
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    per = per.withColumn("source_no", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("source_no") % len(weights) + 1)
    per = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(max_repeats))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), "source_no").rowsBetween(
        Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    per = per.withColumn("level", level)
    per = per.withColumn("shared", F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(
        F.col("cap") / F.col("w"), F.col("level").alias("level")))).over(everything)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("shared") * F.col("w"), F.col("cap")))
    return per.select("source", "source_no", "source_size", target.alias("target"))


def _draw(seed: int, source: int, node: tuple[int, int], n: int, p: float) -> int:
    """A binomial draw that depends only on the seed, the source and the tree node."""
    key = hashlib.blake2b(repr((seed, source, node)).encode(), digest_size=16).digest()
    return int(np.random.Generator(np.random.Philox(key=int.from_bytes(key, "big"))).binomial(n, p))


def drawn_shards(seed: int, source: int, slots: int, shards: int, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """(shard, first slot, number of slots) of the shards in ``lo..hi - 1`` that get slots of a source.

    The slots are split over halves of the shards by binomial draws, down to single shards; halves without slots, and those
    outside ``lo..hi - 1``, are not entered.
    """
    out, todo = [], [(0, shards, 0, slots)]
    while todo:
        a, b, first, n = todo.pop()
        if not n or b <= lo or a >= hi:
            continue
        if b - a == 1:
            out.append((a, first, n))
            continue
        mid = (a + b) // 2
        left = _draw(seed, source, (a, b), n, (mid - a) / (b - a))
        todo += [(mid, b, first + left, n - left), (a, mid, first, left)]
    return out


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of ``0..n-1`` per key: four Feistel rounds, repeated while outside the range."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.uint64) + np.uint64(1)) >> np.uint64(1))
    mask = (np.uint64(1) << half) - np.uint64(1)
    x = index.astype(np.uint64).copy()
    todo = np.arange(len(x))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        a, b = x[todo] >> h, x[todo] & m
        for r in range(4):
            f = (b + k + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f >> np.uint64(32)) & m)
        x[todo] = (a << h) | b
        todo = todo[x[todo] >= n[todo].astype(np.uint64)]
    return x.astype(np.int64)


def _slot_ranges(seed: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for s, blocks, slots, shards, lo, many in zip(p.source_no, p.n_blocks, p.slots, p.shards, p.from_shard, p.many):
                got = drawn_shards(seed, int(s), int(slots), int(shards), int(lo), int(lo) + int(many))
                shard, first, n = (np.array(v, "int64") for v in zip(*got)) if got else (np.zeros(0, "int64"),) * 3
                yield pd.DataFrame({"source_no": np.int32(s), "n_blocks": np.int64(blocks), "shard": shard, "first": first, "n": n})
    return run


def _blocks(seed: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            slot, n = p.slot.to_numpy(), p.n_blocks.to_numpy()
            epoch = slot // np.maximum(n, 1)
            key = (p.source_no.to_numpy().astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                   + epoch.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(seed))
            yield pd.DataFrame({"source_no": p.source_no, "shard": p.shard, "slot": slot, "epoch": epoch,
                                "block": permuted(slot % np.maximum(n, 1), n, key)})
    return run


def draw_slots(sources: DataFrame, *, block_words: int = BLOCK_WORDS, slots_per_shard: int = SLOTS_PER_SHARD,
               seed: int = SEED) -> DataFrame:
    """Every slot of the mix: ``source_no, shard, slot, epoch, block``, from ``source_targets`` rows."""
    sized = (sources.where("source_size > 0")
             .withColumn("n_blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
             .withColumn("slots", F.floor(F.col("n_blocks") * F.col("target") / F.col("source_size") + 0.5).cast("long"))
             .withColumn("shards", F.greatest(F.lit(1), F.ceil(
                 F.sum("slots").over(Window.partitionBy()) / slots_per_shard)).cast("long")))
    # a row for about SLOTS_A_ROW slots: a run of ``many`` shards; only shards that get slots of the source come out of it
    runs = F.least("shards", F.ceil(F.col("slots") / SLOTS_A_ROW))
    each = sized.where("slots > 0").withColumn("many", F.ceil(F.col("shards") / runs).cast("long"))
    each = each.select("source_no", "n_blocks", "slots", "shards", "many", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("shards") - 1, F.col("many"))).alias("from_shard"))
    # few rows that become many: the number of tasks follows the slots
    tasks = max(1, -(-int(sized.agg(F.sum("slots")).first()[0] or 0) // SLOTS_A_TASK))
    ranges = each.repartition(tasks, "source_no", "from_shard").mapInPandas(
        _slot_ranges(seed), "source_no int, n_blocks long, shard long, first long, n long")
    slots = ranges.select(
        "source_no", "n_blocks", "shard",
        F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"))
    return slots.mapInPandas(_blocks(seed), "source_no int, shard long, slot long, epoch long, block long")


def _placed(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Rows of ``docs`` with their size and source, written once (the texts are read in this pass only)."""
    sized = docs.select(*keep, "source", F.size(word_array(F.col(text))).cast("long").alias("size"))
    return cut_lineage(sized, "mix-sizes")


def place(sized: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``source_no, source_size, target`` and ``start``, the row's first word in its source's stream."""
    of = sources.select(F.col("source").alias("__source"), "source_no", "source_size", "target")
    rows = sized.join(of, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
    per = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("in_bucket"))
    earlier = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("source_no", "bucket", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source_no", "bucket").orderBy(*keys, "size").rowsBetween(
        Window.unboundedPreceding, -1)
    return (rows.join(per, ["source_no", "bucket"])
            .withColumn("start", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .drop("bucket", "offset"))


def pieces(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows cut at block borders: ``block`` and the piece's words ``[from_word, to_word)`` of the row."""
    b = F.lit(block_words).cast("long")
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(
        F.floor(F.col("start") / b).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / b).cast("long"))))
    return (cut.withColumn("from_word", F.greatest(F.lit(0), F.col("block") * b - F.col("start")))
            .withColumn("to_word", F.least(F.col("size"), (F.col("block") + 1) * b - F.col("start"))))


def mix_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", *, block_words: int = BLOCK_WORDS,
               slots_per_shard: int = SLOTS_PER_SHARD, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: key, ``size, source_size, target, taken`` (words the mix takes, repeats counted)."""
    sized = _placed(docs, text, [key])
    sources = cut_lineage(source_targets(sized), "mix-sources")
    placed = cut_lineage(place(sized, sources, [key]), "mix-places")
    uses = draw_slots(sources, block_words=block_words, slots_per_shard=slots_per_shard, seed=seed).groupBy(
        "source_no", "block").agg(F.count("*").alias("uses"))
    # Spark takes the exploded slots for small: without the hint it would broadcast them
    taken = (pieces(placed, block_words).join(uses.hint("merge"), ["source_no", "block"])
             .groupBy("source_no", "start")
             .agg(F.sum((F.col("to_word") - F.col("from_word")) * F.col("uses")).alias("taken")))
    # a row with words owns its start; rows without words share it with their successor
    used = placed.where("size > 0").join(taken.hint("merge"), ["source_no", "start"], "left")
    empty = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    cols = [key, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")]
    return used.select(*cols).unionByName(empty.select(*cols))


def word_pieces(text: Column) -> Column:
    """Words with the white space that follows them, so that joining a run of them gives the text back."""
    return F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))


def mix_documents(docs: DataFrame, text: str = "text", *, block_words: int = BLOCK_WORDS,
                  slots_per_shard: int = SLOTS_PER_SHARD, seed: int = SEED) -> DataFrame:
    """The mixed documents with the columns of ``docs``: a row for each document and epoch with the words taken.

    A wholly taken document keeps its text as it is; otherwise its taken pieces are joined in order.
    ``n_chars``, where there is such a column, follows the new text. Rows are matched by a hash of all
    their columns (two 64-bit hashes); equal rows are interchangeable.
    """
    cols = docs.columns
    keys = ["__row_a", "__row_b"]
    tagged = docs.withColumns({"__row_a": F.xxhash64(*cols), "__row_b": F.xxhash64(F.lit(seed), *cols[::-1])})
    sized = _placed(tagged, text, keys)
    sources = cut_lineage(source_targets(sized), "mix-sources")
    placed = cut_lineage(place(sized, sources, keys), "mix-places")
    slots = draw_slots(sources, block_words=block_words, slots_per_shard=slots_per_shard, seed=seed)
    copies = placed.groupBy(*keys).agg(F.count("*").alias("__copies"))
    spans = (pieces(placed, block_words).join(slots.hint("merge"), ["source_no", "block"])
             .groupBy(*keys, "source_no", "start", "epoch")
             .agg(F.sort_array(F.collect_list(F.struct("from_word", "to_word"))).alias("__spans"),
                  F.sum(F.col("to_word") - F.col("from_word")).alias("__taken"), F.first("size").alias("__size"))
             .join(copies, keys).select(*keys, "start", "epoch", "__spans", "__taken", "__size", "__copies"))
    spans = cut_lineage(spans, "mix-spans")

    def with_text(s: DataFrame) -> DataFrame:
        return tagged.join(s.hint("shuffle_hash"), keys)

    # rows that occur once have their spans to themselves; equal rows share theirs, each one is used once
    joined = with_text(spans.where("__copies = 1")).unionByName(
        with_text(spans.where("__copies > 1")).dropDuplicates([*keys, "start", "epoch"]))
    words = F.transform(F.array(word_pieces(F.col(text))), lambda ws: F.concat_ws("", F.transform(
        F.col("__spans"), lambda s: F.concat_ws("", F.slice(
            ws, (s["from_word"] + 1).cast("int"), (s["to_word"] - s["from_word"]).cast("int"))))))
    out = joined.withColumn(
        text, F.when(F.col("__taken") == F.col("__size"), F.col(text)).otherwise(F.element_at(words, 1)))
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*cols)
