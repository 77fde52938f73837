"""Spelling variant grouping: words at one edit from each other, found by search schemes on bidirectional FM-indexes.

Two words are near if they differ by one inserted, deleted or replaced code point. Cut a word in two halves: the edit lies in one
of them, so a near word keeps the other half as it is. A search matches one half exactly together with the delimiter beside it, extending to
the left, then turns round and extends to the right over the other half, allowing one edit, up to the closing delimiter. Turning round needs
an index of both directions: the text ``$word$word...`` and its mirror image, each as the Burrows-Wheeler transform in a
wavelet matrix, whose intervals of suffix ranks are kept in step. The scheme that keeps the right half is the same search over mirrored words.

The vocabulary is range-partitioned by word (and, for the second scheme, by mirrored word) into shards of about ``shard_words``
words, each indexed by itself. Words that share a prefix lie side by side, so a word is searched only in the shards whose range
meets its exact half: mostly one. A frequent prefix spreads over many shards. Queries stream through a shard in blocks, so a
task holds one shard and one block. Each pair of near words is found exactly once: by the first scheme if they share the
first half, else by the second; an edit beside a run of equal letters is placed at the run's end.

Cases: NULL texts hold no words; a NULL ``doc_id`` counts as the empty text in the hash of the misspelling rule; repeated rows count each; ties in
frequency go to the smaller word in code-point order; an empty table, or one without words that count, gives an empty
result; words of any length are taken whole; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmend.llm.common import small_batches
from sparkmend.session import cut_lineage

# The letters of a word.
LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARD_WORDS = 16384
QUERY_BLOCK = 8192
RANGE_POINTS = 64
DELIMITER = 0
DOUBLINGS = 5  # counts grow tenfold along forms, so a chain has at most 18 links in 64 bits: 2^5 reach its end


def dropped_letter(key: Column, run: Column, every: int = 31) -> Column:
    """A run, without one code point where ``every`` divides the hash of ``<key>:<run>``: a rule that plants misspellings."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least_length: int = 7, least_count: int = 2,
               every: int = 31) -> DataFrame:
    """``word, n``: the distinct words of all texts that are long and frequent enough (after ``dropped_letter``)."""
    runs = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    each = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.explode(runs).alias("run"))
    return (each.select(dropped_letter(F.col("k"), F.col("run"), every).alias("word")).where(F.char_length("word") >= least_length)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count))


class Ranks:
    """A text's Burrows-Wheeler transform as a wavelet matrix: narrows suffix intervals by a symbol to the left."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        self.order = _sorted_rotations(text, symbols)
        self.last = text[self.order - 1]
        self.levels = max(1, int(symbols - 1).bit_length())
        starts = np.zeros(symbols, "int64")
        first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))[:-1]])
        zeros, row = [], self.last
        for level in range(self.levels):
            bit = (row >> (self.levels - 1 - level)) & 1
            zeros.append(np.concatenate([[0], np.cumsum(1 - bit)]).astype("int32"))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
            own = (np.arange(symbols) >> (self.levels - 1 - level)) & 1
            starts = np.where(own == 1, zeros[-1][-1] + starts - zeros[-1][starts], zeros[-1][starts])
        self.zeros, self.base = zeros, first - starts

    def extend(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(low, high, rows with a smaller symbol) of the intervals ``[low, high)`` extended by the symbols ``c``."""
        smaller = np.zeros(len(c), "int64")
        for level, zeros in enumerate(self.zeros):
            one = ((c >> (self.levels - 1 - level)) & 1).astype(bool)
            a, b = zeros[low].astype("int64"), zeros[high].astype("int64")
            smaller += np.where(one, b - a, 0)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return self.base[c] + low, self.base[c] + high, smaller


def _sorted_rotations(text: np.ndarray, symbols: int) -> np.ndarray:
    """Start positions of the text's rotations in order, by doubling the compared length."""
    n, bits = len(text), max(1, int(symbols - 1).bit_length())
    span = 62 // bits
    key = np.zeros(n, "int64")
    for i in range(span):
        key = (key << bits) | np.roll(text, -i)
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank_in_order = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if rank_in_order[-1] == n - 1 or span >= n:
            return order
        rank = np.empty(n, "int64")
        rank[order] = rank_in_order
        key = rank * n + np.roll(rank, -span)
        span *= 2


def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, and the lengths."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "uint32"), np.fromiter(map(len, words), "int64", len(words))


class Vocabulary:
    """Bidirectional FM-index over the delimited words of a shard."""

    def __init__(self, words: list[str]) -> None:
        points, lengths = _flat(words)
        self.alphabet = np.unique(points)
        self.symbols = len(self.alphabet) + 1
        text = np.zeros(len(points) + len(words), "int64")
        number = np.repeat(np.arange(len(words)), lengths)
        text[np.arange(len(points)) + number + 1] = np.searchsorted(self.alphabet, points) + 1
        owner = np.repeat(np.arange(len(words)), lengths + 1)
        self.forward, self.mirror = Ranks(text, self.symbols), Ranks(text[::-1].copy(), self.symbols)
        self.owner = owner[::-1].copy()  # the word at each place of the mirrored text

    def coded(self, points: np.ndarray) -> np.ndarray:
        """Symbols of code points; -1 for those that no word of the shard holds."""
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, -1)

    def near(self, words: list[str], halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the query word, number of a word of the shard) of all pairs at one edit that share the first ``halves`` code points."""
        points, lengths = _flat(words)
        offset = np.cumsum(lengths) - lengths
        flat = np.append(self.coded(points), DELIMITER)

        def symbol(q: np.ndarray, at: np.ndarray) -> np.ndarray:
            """The query's symbol at a place; the delimiter beyond its ends."""
            return np.where((at >= 0) & (at < lengths[q]), flat[np.clip(offset[q] + at, 0, len(flat) - 1)], DELIMITER)

        # the exact half and the delimiter before it, to the left; the mirrored interval is kept in step
        q = np.arange(len(words))
        low, high = np.zeros(len(q), "int64"), np.full(len(q), len(self.owner))
        m_low, at = low.copy(), halves - 1
        ready = []
        while len(q):
            c = symbol(q, at)
            live = c >= 0
            q, at, c, low, high, m_low = (v[live] for v in (q, at, c, low, high, m_low))
            low, high, smaller = self.forward.extend(c, low, high)
            m_low = m_low + smaller
            live, done = high > low, at < 0
            ready.append((q[live & done], m_low[live & done], (m_low + high - low)[live & done]))
            q, at, low, high, m_low = (v[live & ~done] for v in (q, at - 1, low, high, m_low))
        q, low, high = (np.concatenate(v) for v in zip(*ready)) if ready else (q, low, high)
        # the other half to the right: ``plain`` searches without an edit so far, ``edited`` ones after it
        plain, edited, found = (q, halves[q], low, high), [], []
        while len(plain[0]) or edited:
            q, at, low, high = plain
            if len(q):
                edited += self._edits(q, at, low, high, symbol, lengths)
            if edited:
                done, edited = self._exact(*(np.concatenate(v) for v in zip(*edited)), symbol, lengths)
                found.append(done)
            inside = at < lengths[q]
            q, at, low, high = q[inside], at[inside], low[inside], high[inside]
            c = symbol(q, at)
            live = c >= 0
            q, at, c, low, high = q[live], at[live], c[live], low[live], high[live]
            low, high, _ = self.mirror.extend(c, low, high)
            live = high > low
            plain = (q[live], at[live] + 1, low[live], high[live])
        if not found:
            return np.zeros(0, "int64"), np.zeros(0, "int64")
        return tuple(np.concatenate(v) for v in zip(*found))

    def _next_symbols(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the interval, symbol) of the letters that follow somewhere in each interval."""
        size = high - low
        wide = size > self.symbols
        who = [np.repeat(np.flatnonzero(wide), self.symbols - 1)]
        letter = [np.tile(np.arange(1, self.symbols), int(wide.sum()))]
        narrow = np.flatnonzero(~wide)
        owner = np.repeat(narrow, size[narrow])
        place = np.arange(len(owner)) - np.repeat(np.cumsum(size[narrow]) - size[narrow], size[narrow]) + low[owner]
        pair = np.unique(owner * self.symbols + self.mirror.last[place])
        who.append(pair // self.symbols)
        letter.append(pair % self.symbols)
        who, letter = np.concatenate(who), np.concatenate(letter)
        return who[letter != DELIMITER], letter[letter != DELIMITER]

    def _edits(self, q, at, low, high, symbol, lengths) -> list[tuple]:
        """Searches with the one edit at this place: a letter replaced, inserted or deleted."""
        here = symbol(q, at)
        who, letter = self._next_symbols(low, high)
        other = letter != here[who]
        who, letter = who[other], letter[other]
        a, b, _ = self.mirror.extend(letter, low[who], high[who])
        live = b > a
        who, a, b = who[live], a[live], b[live]
        inserted = (q[who], at[who], a, b)
        inside = at[who] < lengths[q[who]]
        replaced = (q[who][inside], at[who][inside] + 1, a[inside], b[inside])
        gone = (at < lengths[q]) & (here != symbol(q, at + 1))
        return [inserted, replaced, (q[gone], at[gone] + 1, low[gone], high[gone])]

    def _exact(self, q, at, low, high, symbol, lengths) -> tuple[tuple, list[tuple]]:
        """One exact step of the edited searches: (pairs that reached the closing delimiter, searches that go on)."""
        c = symbol(q, at)
        live = c >= 0
        q, at, c, low, high = q[live], at[live], c[live], low[live], high[live]
        low, high, _ = self.mirror.extend(c, low, high)
        live = high > low
        end = live & (at >= lengths[q])
        place = self.mirror.order[low[end]]
        on = live & ~end
        rest = [(q[on], at[on] + 1, low[on], high[on])] if on.any() else []
        return (q[end], self.owner[(place + 1) % len(self.owner)]), rest


def _shards(vocab: DataFrame, scheme: int, shards: int) -> tuple[DataFrame, DataFrame]:
    """Index rows and query rows of one scheme: ``scheme, shard, kind, key, half, n``."""
    spark = vocab.sparkSession
    key = F.col("word") if scheme == 0 else F.reverse("word")
    index = cut_lineage(vocab.select(key.alias("key"), "n").repartitionByRange(shards, "key")
                        .withColumn("shard", F.spark_partition_id()), "shards")
    # two short texts a shard: of very long words the start, which only widens the range
    ends = index.groupBy("shard").agg(
        F.substring(F.min("key"), 1, RANGE_POINTS).alias("first"),
        F.concat(F.substring(F.max("key"), 1, RANGE_POINTS), F.lit("\U0010ffff")).alias("last")).orderBy("shard").collect()
    shared = spark.sparkContext.broadcast(([r.shard for r in ends], [r["first"] for r in ends], [r["last"] for r in ends]))

    @F.pandas_udf("array<int>")
    def meeting(prefix: pd.Series) -> pd.Series:
        from bisect import bisect_left, bisect_right
        number, first, last = shared.value
        return pd.Series([number[bisect_left(last, p):bisect_right(first, p + "\U0010ffff")] for p in prefix])

    half = F.floor(F.char_length("key") / 2) if scheme == 0 else F.char_length("key") - F.floor(F.char_length("key") / 2)
    queries = index.select("key", half.cast("int").alias("half")).withColumn("shard", F.explode(meeting(F.substring("key", F.lit(1), F.col("half")))))
    columns = [F.lit(scheme).alias("scheme"), "shard"]
    return (index.select(*columns, F.lit(0).alias("kind"), "key", F.lit(0).alias("half"), "n"),
            queries.select(*columns, F.lit(1).alias("kind"), "key", "half", F.lit(0).cast("long").alias("n")))


def near_pairs(vocab: DataFrame, *, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``word, near, near_n``: every ordered pair of near words of ``vocab`` (distinct ``word``, with its count ``n``), once."""
    spark = vocab.sparkSession
    small_batches(spark)
    vocab = cut_lineage(vocab.select("word", "n"), "vocabulary")
    shards = max(1, -(-vocab.count() // shard_words))
    parts = [rows for scheme in (0, 1) for rows in _shards(vocab, scheme, shards)]
    rows = parts[0].union(parts[1]).union(parts[2]).union(parts[3])

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = {}

        def pieces() -> Iterator[tuple[tuple, pd.DataFrame]]:
            for p in parts:
                for name, piece in p.groupby(["scheme", "shard", "kind"], sort=True):
                    yield name, piece

        for (scheme, shard, kind), group in groupby(pieces(), key=lambda x: x[0]):
            if kind == 0:
                held = pd.concat([p for _, p in group])
                words = held.key.tolist()
                state = {"of": (scheme, shard), "words": np.array(words, object), "n": held.n.to_numpy(), "index": Vocabulary(words)}
                continue
            if state.get("of") != (scheme, shard):
                continue
            for _, block in group:
                for start in range(0, len(block), QUERY_BLOCK):
                    asked = block.key.iloc[start:start + QUERY_BLOCK].tolist()
                    half = block.half.iloc[start:start + QUERY_BLOCK].to_numpy("int64")
                    who, got = state["index"].near(asked, half)
                    word, near = [asked[i] for i in who], state["words"][got].tolist()
                    if scheme:  # mirrored; pairs that share the first half belong to the other scheme
                        keep = [i for i, (a, b, h) in enumerate(zip(word, near, half[who])) if a[h:] != b[len(b) - len(a) + h:]]
                        word, near, got = [word[i][::-1] for i in keep], [near[i][::-1] for i in keep], got[keep]
                    if len(word):
                        yield pd.DataFrame({"word": word, "near": near, "near_n": state["n"][got]})

    return (rows.repartition(4 * shards, "scheme", "shard").sortWithinPartitions("scheme", "shard", "kind")
            .mapInPandas(search, "word string, near string, near_n long"))


def group_variants(vocab: DataFrame, *, ratio: int = 10, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``word, n, n_near, form, form_n, root``: the near word that is ``ratio`` times as frequent, if any, and where forms lead to."""
    vocab = cut_lineage(vocab.select("word", "n"), "words")
    found = near_pairs(vocab, shard_words=shard_words).select(
        "word", F.lit(None).cast("long").alias("n"), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")).alias("best"))
    none = F.lit(None).cast(found.schema["best"].dataType)
    words = vocab.select("word", "n", none.alias("best")).union(found).groupBy("word").agg(
        F.max("n").alias("n"), F.count("best").alias("n_near"), F.min("best").alias("best"))
    formed = -F.col("best.less") >= ratio * F.col("n")
    words = cut_lineage(words.select("word", "n", "n_near", F.when(formed, F.col("best.near")).alias("form"),
                                     F.when(formed, -F.col("best.less")).alias("form_n")), "forms")
    # each round doubles the links that ``root`` has followed
    chain = words.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        on = chain.alias("a").join(chain.alias("b"), F.col("a.root") == F.col("b.word"), "left")
        chain = cut_lineage(on.select("a.word", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved")), "roots")
        if chain.where("moved").isEmpty():
            break
        chain = chain.drop("moved")
    roots = chain.select("word", "root")
    return words.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
