"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

The words of all texts are counted, and the frequent ones (at most ``LEXICON_WORDS``) are encoded once and compiled into a
minimal acyclic automaton over their UTF-8 bytes: words share prefixes and suffixes, and every arc carries a number; the sum along a
word's path is the word's place in the table of id sequences. The compiled arrays are broadcast (their size is bounded by the number
of words), stored once in each executor's folder of distributed files and memory-mapped by all its Python processes; a lost executor's
successor stores them anew. A batch walks all its distinct words through the automaton together, a byte a step. Words that it
does not accept are merged exactly: the pair of lowest rank first, the leftmost of equal ones.

What the tokenizer's file says about normalization and words is followed here: NFC, white space, lower case by code point (no final sigma), then
contractions, runs of letters, single digits and runs of other marks. Texts with code points that this Python's Unicode tables lack go
through the library's normalizer and splitter, as its tables are newer. Special strings inside a text become their ids. Decoding joins the
tokens' strings with a blank, as the file names no decoder.

Cases: NULL and empty texts have no ids and decode to the empty text; very long texts are cut into chunks at white space, so a task holds a chunk's words; a
word of any length is merged in ``n log n``; repeated rows are encoded each; empty tables give empty results; other columns stay, and one
that has the name of a result column is replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import Broadcast, SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmend.llm.common import small_batches
from sparkmend.session import cut_lineage

LEXICON_WORDS = 1 << 17
CHUNK_POINTS = 1 << 20   # code points whose words a task holds at a time
COUNTED_POINTS = 1 << 22  # code points whose words are counted together: more of them are the same word
MEMO_WORDS = 1 << 17     # merged words that a process remembers
SHORT_WORD = 40          # up to here a scan for the best pair is faster than a heap
BUCKETS = 16             # steps of the count histogram in a doubling
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0D\x20a-z0-9]+")
BLANK = regex.compile(r"\p{White_Space}")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


@lru_cache(1)
def _unknown() -> np.ndarray:
    """For every code point whether this Python's Unicode tables lack it."""
    return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)), bool, 0x110000)


class Bpe:
    """Words and exact merges by a tokenizer file."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        model, letters = spec["model"], byte_letters()
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.first = [vocab[c] for c in letters]
        self.final = [vocab[c + end] for c in letters]
        self.merged = {(vocab[a] << 32) | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.tokens = np.array([t for t, _ in sorted({**vocab, **self.special}.items(), key=lambda x: x[1])], object)
        longest = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(longest) + ")") if longest else None
        self.content, self.byte_of, self.library = content, {c: b for b, c in enumerate(letters)}, None
        self.memo: dict[str, list[int]] = {}

    def words(self, text: str) -> list[str]:
        """The words of a text that is merged each by itself; special strings stay whole."""
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        out = []
        for i, piece in enumerate(self.cut.split(text)):
            out += [piece] if i % 2 else self._plain(piece)
        return out

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return ASCII_WORDS.findall(text.lower())
        if _unknown()[np.frombuffer(text.encode("utf-32-le"), "uint32")].any():
            return self._by_library(text)
        return WORDS.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _by_library(self, text: str) -> list[str]:
        if self.library is None:
            from tokenizers import Tokenizer
            self.library = Tokenizer.from_str(self.content)
        split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.byte_of[c] for c in word).decode() for word, _ in split]

    def merge(self, word: str) -> list[int]:
        """Ids of one word, exactly."""
        if word in self.special:
            return [self.special[word]]
        got = self.memo.get(word)
        if got is None:
            data = word.encode()
            ids = [self.first[b] for b in data[:-1]] + [self.final[data[-1]]]
            got = self._scanned(ids) if len(ids) <= SHORT_WORD else self._by_heap(ids)
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            if len(word) <= SHORT_WORD:
                self.memo[word] = got
        return got

    def _scanned(self, ids: list[int]) -> list[int]:
        get, none = self.merged.get, (1 << 62, 0)
        pairs = [get((a << 32) | b, none) for a, b in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best is none:
                break
            i = pairs.index(best)
            ids[i:i + 2] = [best[1]]
            del pairs[i]
            if i > 0:
                pairs[i - 1] = get((ids[i - 1] << 32) | ids[i], none)
            if i < len(pairs):
                pairs[i] = get((ids[i] << 32) | ids[i + 1], none)
        return ids

    def _by_heap(self, ids: list[int]) -> list[int]:
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                got = self.merged.get((ids[i] << 32) | ids[j])
                if got:
                    heapq.heappush(heap, (got[0], i, ids[i], ids[j], got[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]


def compile_lexicon(words: dict[bytes, list[int]]) -> np.ndarray:
    """Minimal acyclic transducer of ``words`` as one array of 32-bit numbers (see ``Lexicon``).

    Words are added in order; a state that no later word can change is replaced by an equal one that is there already.
    """
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    path: list[tuple[int, int]] = []  # (state, byte) along the word added last, not replaced so far

    def settle(keep: int) -> None:
        while len(path) > keep:
            state, byte = path.pop()
            child = arcs[state][byte]
            arcs[state][byte] = known.setdefault((final[child], tuple(arcs[child].items())), child)

    last = b""
    ordered = sorted(words)
    for word in ordered:
        same = len(os.path.commonprefix([last, word]))
        settle(same)
        state = arcs[path[-1][0]][path[-1][1]] if path else 0
        for byte in word[same:]:
            arcs.append({})
            final.append(False)
            arcs[state][byte] = len(arcs) - 1
            path.append((state, byte))
            state = len(arcs) - 1
        final[state] = True
        last = word
    settle(0)
    # number the states that are left, and count the words that each accepts
    accepted: dict[int, int] = {}
    order, todo = [], [(0, False)]
    while todo:
        state, done = todo.pop()
        if done:
            accepted[state] = final[state] + sum(accepted[t] for t in arcs[state].values())
            order.append(state)
        elif state not in accepted:
            accepted[state] = 0
            todo += [(state, True), *((t, False) for t in arcs[state].values() if t not in accepted)]
    number = {s: i for i, s in enumerate(reversed(order))}  # the start is 0
    keys, targets, adds = [], [], []
    for state in reversed(order):
        before = int(final[state])
        for byte, target in sorted(arcs[state].items()):
            keys.append(number[state] * 256 + byte)
            targets.append(number[target])
            adds.append(before)
            before += accepted[target]
    ends = [int(final[s]) for s in reversed(order)]
    offsets = np.concatenate([[0], np.cumsum([len(words[w]) for w in ordered])])
    ids = [i for w in ordered for i in words[w]]
    parts = [ends, keys, targets, adds, offsets, ids]
    return np.concatenate([[len(p) for p in parts], *parts]).astype("int32")


class Lexicon:
    """A compiled transducer: states' end marks, arcs (state * 256 + byte, target, number), id sequences."""

    def __init__(self, data: np.ndarray) -> None:
        edges = 6 + np.concatenate([[0], np.cumsum(data[:6])])
        self.ends, self.keys, self.targets, self.adds, self.offsets, self.ids = (data[a:b] for a, b in zip(edges, edges[1:]))

    def places(self, words: list[str]) -> np.ndarray:
        """Place of each word in the table of id sequences; -1 for words that the automaton does not accept."""
        encoded = [w.encode() for w in words]
        sizes = np.fromiter(map(len, encoded), "int64", len(encoded))
        data = np.frombuffer(b"".join(encoded), "uint8")
        out = np.full(len(words), -1)
        if not len(self.keys):
            return out
        who, at = np.arange(len(words)), np.cumsum(sizes) - sizes
        stop = at + sizes
        state, total = np.zeros(len(words), "int64"), np.zeros(len(words), "int64")
        while len(who):
            key = state * 256 + data[at]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            live = self.keys[arc] == key
            who, at, stop, arc, total = who[live], at[live] + 1, stop[live], arc[live], total[live]
            state, total = self.targets[arc].astype("int64"), total + self.adds[arc]
            end = at == stop
            fits = end & (self.ends[state] == 1)
            out[who[fits]] = total[fits]
            who, at, stop, state, total = (v[~end] for v in (who, at, stop, state, total))
        return out


class Model:
    """What tasks need: the tokenizer file's content and the compiled lexicon, broadcast."""

    def __init__(self, content: Broadcast, lexicon: Broadcast, digest: str) -> None:
        self.content, self.lexicon, self.digest = content, lexicon, digest

    def opened(self) -> tuple[Bpe, Lexicon]:
        """The tokenizer and the memory-mapped lexicon, once a process."""
        if self.digest not in _OPENED:
            _OPENED.clear()
            path = os.path.join(SparkFiles.getRootDirectory(), f"lexicon-{self.digest}")
            if not os.path.exists(path):
                own = f"{path}-{os.getpid()}"
                with open(own, "wb") as f:
                    f.write(self.lexicon.value)
                os.replace(own, path)
            _OPENED[self.digest] = Bpe(self.content.value), Lexicon(np.memmap(path, "int32", "r"))
        return _OPENED[self.digest]


_OPENED: dict[str, tuple[Bpe, Lexicon]] = {}


def chunks(text: str) -> Iterator[str]:
    """A text in parts of about ``CHUNK_POINTS``, cut before white space (never inside a word)."""
    start = 0
    while len(text) - start > CHUNK_POINTS:
        blank = BLANK.search(text, start + CHUNK_POINTS)
        if blank is None:
            break
        yield text[start:blank.start()]
        start = blank.start()
    yield text[start:] if start else text


def _word_groups(bpe: Bpe, texts: list[str | None], most: int | None = None) -> Iterator[tuple[list[str], list[int], list[int]]]:
    """(words, row of each chunk, words of each chunk) for groups of chunks of about ``most`` code points together (``CHUNK_POINTS``)."""
    most = CHUNK_POINTS if most is None else most
    words, rows, sizes, points = [], [], [], 0
    for row, text in enumerate(texts):
        for part in chunks(text or ""):
            got = bpe.words(part)
            words += got
            rows.append(row)
            sizes.append(len(got))
            points += len(part)
            if points >= most:
                yield words, rows, sizes
                words, rows, sizes, points = [], [], [], 0
    yield words, rows, sizes


def word_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``word, n``: how often each word occurs in all texts."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(_content(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(shared.value)
        for batch in batches:
            for words, _, _ in _word_groups(bpe, batch.column(0).to_pylist(), COUNTED_POINTS):
                codes, distinct = pd.factorize(np.array(words, object))
                yield pa.RecordBatch.from_arrays([pa.array(distinct.tolist(), pa.string()), pa.array(np.bincount(codes, minlength=len(distinct)), pa.int64())], ["word", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _content(path: str) -> str:
    with open(path, encoding="utf-8") as f:  # a tokenizer file of the driver's installation, sent to the tasks by content
        return f.read()


def learn(docs: DataFrame, path: str, text: str = "text", lexicon_words: int = LEXICON_WORDS) -> Model:
    """The lexicon of the most frequent words of all texts (down to a count at which at most ``lexicon_words`` are left)."""
    spark = docs.sparkSession
    bpe = Bpe(_content(path))
    bucket = F.floor(F.log2("n") * BUCKETS).cast("int")
    counted = cut_lineage(word_counts(docs, path, text).withColumn("bucket", bucket), "word-counts")
    # at most 16 rows for a doubling of the count
    sizes = sorted(((r.bucket, r["count"]) for r in counted.groupBy("bucket").count().collect()), reverse=True)
    least, total = None, 0
    for at, n in sizes:
        total += n
        if total > lexicon_words:
            break
        least = at
    frequent = [] if least is None else [r.word for r in counted.where(F.col("bucket") >= least).select("word").collect()]
    data = compile_lexicon({w.encode(): bpe.merge(w) for w in frequent if w not in bpe.special}).tobytes()
    sc = spark.sparkContext
    return Model(sc.broadcast(bpe.content), sc.broadcast(data), hashlib.sha256(data + bpe.content.encode()).hexdigest()[:24])


def encoded_rows(bpe: Bpe, lexicon: Lexicon, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and where each text's begin (one more for the end)."""
    per_row, out = np.zeros(len(texts), "int64"), []
    for words, rows, sizes in _word_groups(bpe, texts):
        codes, distinct = pd.factorize(np.array(words, object))
        place = lexicon.places(distinct.tolist())
        unseen = np.flatnonzero(place < 0)
        merged = [bpe.merge(distinct[i]) for i in unseen]
        ids = np.concatenate([lexicon.ids, *merged]).astype("int32") if merged else np.asarray(lexicon.ids)
        begin, many = np.zeros(len(distinct), "int64"), np.zeros(len(distinct), "int64")
        seen = place >= 0
        begin[seen] = lexicon.offsets[place[seen]]
        many[seen] = lexicon.offsets[place[seen] + 1] - begin[seen]
        many[unseen] = np.fromiter(map(len, merged), "int64", len(merged))
        begin[unseen] = len(lexicon.ids) + np.cumsum(many[unseen]) - many[unseen]
        each = many[codes]
        ends = np.cumsum(each)
        out.append(ids[np.repeat(begin[codes] - (ends - each), each) + np.arange(int(each.sum()))])
        owner = np.repeat(np.array(rows, "int64"), np.array(sizes, "int64"))
        per_row += np.bincount(owner, weights=each, minlength=len(texts)).astype("int64")
    return np.concatenate(out) if out else np.zeros(0, "int32"), np.concatenate([[0], np.cumsum(per_row)])


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    kept = {n: c for n, c in zip(batch.schema.names, batch.columns) if n not in columns}
    return pa.RecordBatch.from_arrays([*kept.values(), *columns.values()], [*kept, *columns])


def _encode(model: Model, text: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, lexicon = model.opened()
        for batch in batches:
            ids, offsets = encoded_rows(bpe, lexicon, batch.column(text).to_pylist())
            yield _with(batch, ids=pa.ListArray.from_arrays(pa.array(offsets.astype("int32")), pa.array(ids)))
    return run


def _decode(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = model.opened()[0].tokens
        for batch in batches:
            rows = batch.column("ids")
            values, offsets = rows.values.to_numpy(zero_copy_only=False), rows.offsets.to_numpy()
            decoded = [" ".join(tokens[values[a:b]].tolist()) for a, b in zip(offsets, offsets[1:])]
            yield _with(batch, decoded=pa.array(decoded, pa.string()))
    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column("ids")
        values, offsets = rows.values.to_numpy(zero_copy_only=False).astype("<u4"), rows.offsets.to_numpy()
        digests = [hashlib.sha256(values[a:b].tobytes()).hexdigest() for a, b in zip(offsets, offsets[1:])]
        texts = [hashlib.sha256(t.encode()).hexdigest() for t in batch.column("decoded").to_pylist()]
        done = _with(batch, n_tokens=pa.array(np.diff(offsets).astype("int64")), ids_sha256=pa.array(digests), decoded_sha256=pa.array(texts))
        yield done.select([n for n in done.schema.names if n not in ("ids", "decoded")])


def _schema(df: DataFrame, **columns: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name not in columns), *(T.StructField(n, t) for n, t in columns.items())])


def encode(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns and ``ids``, the token ids of the whole text."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_encode(model, text), _schema(docs, ids=T.ArrayType(T.IntegerType())))


def decode(rows: DataFrame, model: Model) -> DataFrame:
    """All columns and ``decoded``, the text of ``ids`` (NULL ids decode to the empty text)."""
    small_batches(rows.sparkSession)
    rows = rows.withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))
    return rows.mapInArrow(_decode(model), _schema(rows, decoded=T.StringType()))


def digests(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns but the text, with ``n_tokens`` and the digests of the ids and of the text decoded from them.

    Encoding, decoding and digests run one after the other in the same task, batch by batch.
    """
    small_batches(docs.sparkSession)
    first, second = _encode(model, text), _decode(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _digest(second(first(batches))):
            yield batch.select([n for n in batch.schema.names if n != text])

    digest = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    dropped = docs.drop("ids", "decoded", text)
    return docs.mapInArrow(run, _schema(dropped, **digest))
