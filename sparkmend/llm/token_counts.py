"""Token counts by finite-state tokenizer compilation.

A byte-level BPE tokenizer file (``.json``) is compiled into two deterministic transducers.

*Splitter.* The pre-tokenizer's pattern (contractions; runs of letters, digits or other signs, each with at
most one space before it; white space, of which the last one before a word stays with it) becomes a
transducer over character classes. Its transitions say whether a piece starts at this character. A batch of
texts is one character stream, cut into chunks of equal length. All chunks run from all states at once, which
gives one state map a chunk; the maps compose through a parallel prefix scan, so every chunk knows its first
state, and a second run marks the piece starts. A very long text is only more chunks.

*Counter.* The BPE merges become a transducer over bytes whose transitions carry the change in the number of
tokens: after each byte it knows how many tokens the piece has so far. It rests on the property that
the encoding of a prefix without its last token is again the encoding of that shorter prefix. So the last token at a
byte is the longest vocabulary suffix whose neighbour, the last token before it, would not be merged across the
seam. A state is what later bytes can still see: for each place where an unfinished token may have started, the
last token before it and the token count there, relative to now. States and transitions are determinised
on first use and kept in a table that all batches of a Python worker share; beyond ``max_states`` it starts
anew, which bounds memory and changes no result. Pieces run through it side by side, one byte a step.

Each text is counted on its own, without a shuffle. Cases: NULL and empty texts have 0 bytes and 0 tokens;
special strings inside a text count as one token each, as the library does by default; very long texts and
pieces only take more steps; repeated rows count alike; an empty table gives an empty result; columns with
the names of the result are replaced.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmend.llm.common import small_batches

BATCH_CHARS = 2_000_000
CHUNK = 256
MAX_STATES = 250_000

# Character classes of the splitter. Letters of the contractions are classes of their own.
SPACE, WHITE, LETTER, NUMBER, OTHER, QUOTE, L_S, L_T, L_M, L_D, L_R, L_E, L_V, L_L, FENCE = range(15)
CLASSES = 15
LETTERS = {LETTER, L_S, L_T, L_M, L_D, L_R, L_E, L_V, L_L}
# The contraction endings of the pre-tokenizer's pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _class_table() -> np.ndarray:
    """Class of every code point, from the Unicode general categories and the White_Space property."""
    import regex
    table = np.full(0x110000, OTHER, "uint8")
    for cp in range(0x110000):
        if 0xD800 <= cp < 0xE000:
            continue
        kind = unicodedata.category(chr(cp))[0]
        if kind in "LN":
            table[cp] = LETTER if kind == "L" else NUMBER
    for m in regex.finditer(r"\s", "".join(chr(c) for c in range(0x3100))):
        table[ord(m[0])] = WHITE
    table[0x20], table[0x27] = SPACE, QUOTE
    for ch, c in zip("stmdrevl", (L_S, L_T, L_M, L_D, L_R, L_E, L_V, L_L)):
        table[ord(ch)] = c
    return table


class Splitter:
    """The pre-tokenizer as a transducer over (class, next two classes): which characters start a piece.

    The only look-ahead of the pattern is one character after white space and two after a quote; the input
    symbol therefore joins a character's class with a two-bit summary of what follows it.
    """

    # What a character continues: nothing (piece start forced), a run, or the rest of a contraction.
    START, AFTER_SPACE, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, TAIL_1, TAIL_2 = range(8)
    STATES = 8

    def __init__(self) -> None:
        self.classes = _class_table()
        symbols = CLASSES * 4
        self.next = np.zeros((symbols, self.STATES), "uint8")
        self.begins = np.zeros((symbols, self.STATES), bool)
        for c in range(CLASSES):
            for look in range(4):
                for s in range(self.STATES):
                    self.next[c * 4 + look, s], self.begins[c * 4 + look, s] = self._step(c, look, s)

    def _step(self, c: int, look: int, s: int) -> tuple[int, bool]:
        """look, for white space: 1 if a character that is not white follows at once; for a quote: the
        length of the contraction ending that follows (0 if there is none)."""
        if c == FENCE:
            return self.START, True
        if s == self.TAIL_2:
            return self.TAIL_1, False
        if s == self.TAIL_1:
            return self.START, False
        if c in (SPACE, WHITE):
            if look == 1 and c == SPACE:  # joins the word that follows
                return self.AFTER_SPACE, True
            begins = s != self.IN_WHITE or look == 1
            return (self.START if look == 1 else self.IN_WHITE), begins
        run = self.IN_LETTERS if c in LETTERS else self.IN_NUMBERS if c == NUMBER else self.IN_OTHER
        if s == self.AFTER_SPACE or s == run:
            return run, False
        if c == QUOTE and look:
            return (self.TAIL_1 if look == 1 else self.TAIL_2), True
        return run, True

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        c = self.classes[codes]
        c[codes == 0x10FFFF] = FENCE
        after = np.append(c[1:], FENCE)
        after2 = np.append(c[2:], (FENCE, FENCE))[: len(c)]
        look = np.zeros(len(c), "uint8")
        white = (c == SPACE) | (c == WHITE)
        look[white & (after != SPACE) & (after != WHITE) & (after != FENCE)] = 1
        quote = np.flatnonzero(c == QUOTE)
        a, b = after[quote], after2[quote]
        one = (a == L_S) | (a == L_T) | (a == L_M) | (a == L_D)
        two = (((a == L_R) | (a == L_V)) & (b == L_E)) | ((a == L_L) & (b == L_L))
        look[quote] = np.where(one, 1, np.where(two, 2, 0))
        return c * np.uint8(4) + look

    def starts(self, codes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """True where a piece starts; ``codes`` are code points, with 0x10FFFF as the fence between texts."""
        n = len(codes)
        symbols = self.symbols(codes)
        rows = -(-n // chunk)
        grid = np.full(rows * chunk, FENCE * 4, "uint8")
        grid[:n] = symbols
        grid = np.ascontiguousarray(grid.reshape(rows, chunk).T)
        maps = np.tile(np.arange(self.STATES, dtype="uint8"), (rows, 1))
        for row in grid:  # the state map of every chunk
            maps = self.next[row[:, None], maps]
        first = self._scan(maps)
        marks = np.empty((chunk, rows), bool)
        state = first
        for i, row in enumerate(grid):
            marks[i] = self.begins[row, state]
            state = self.next[row, state]
        return marks.T.reshape(-1)[:n]

    def _scan(self, maps: np.ndarray) -> np.ndarray:
        """First state of each chunk: inclusive prefix composition of the maps by doubling, shifted by one."""
        total, step = maps, 1
        while step < len(total):
            joined = total.copy()
            joined[step:] = np.take_along_axis(total[step:], total[:-step], axis=1)
            total, step = joined, step * 2
        first = np.zeros(len(total), "uint8")
        first[1:] = total[:-1, self.START]
        return first


class Counter:
    """The BPE merges as a transducer over bytes; transitions carry the change in the number of tokens."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]], max_states: int = MAX_STATES) -> None:
        self.tokens = set(vocab)
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.parts: dict[bytes, tuple[bytes, bytes]] = {}
        for a, b in merges:
            self.parts.setdefault(a + b, (a, b))
        self.prefixes = {t[:i] for t in self.tokens for i in range(len(t) + 1)}
        self.max_states = max_states
        self.seams: dict[tuple[bytes, bytes], bool] = {}
        self.spines: dict[tuple[bytes, int], list] = {}
        self.reset()

    def reset(self) -> None:
        # state: ((token before the open place, tokens up to there minus tokens now, bytes since), ...), longest first
        root = ((b"", 0, b""),)
        self.ids = {root: 0}
        self.states = [root]
        self._grow(1 << 16)

    def _grow(self, slots: int) -> None:
        """An empty (or copied) open-addressing table: state * 256 + byte -> (next state, change)."""
        old = getattr(self, "key", None) if len(self.states) > 1 else None
        entries = [] if old is None else [(k, t, d) for k, t, d in zip(old, self.to, self.change) if k >= 0]
        self.mask, self.filled = slots - 1, 0
        self.key = np.full(slots, -1, "int64")
        self.to = np.zeros(slots, "int32")
        self.change = np.zeros(slots, "int8")
        for k, t, d in entries:
            self._put(int(k), int(t), int(d))

    def _put(self, key: int, to: int, change: int) -> None:
        slot = (key * 0x9E3779B1 >> 8) & self.mask
        while self.key[slot] >= 0:
            slot = (slot + 1) & self.mask
        self.key[slot], self.to[slot], self.change[slot] = key, to, change
        self.filled += 1

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where the table lacks it."""
        slot = (keys * 0x9E3779B1 >> 8) & self.mask
        there = self.key[slot]
        todo = np.flatnonzero((there != keys) & (there >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            there[todo] = self.key[slot[todo]]
            todo = todo[(there[todo] != keys[todo]) & (there[todo] >= 0)]
        slot[there != keys] = -1
        return slot

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """Tokens on the outer edge of a token's merge tree, each with the rank that consumes it."""
        got = self.spines.get((token, side))
        if got is None:
            got, last = [], len(self.rank)
            while True:
                got.append((token, last))
                if token not in self.parts:
                    break
                pair = self.parts[token]
                last, token = self.rank[pair], pair[side]
            self.spines[(got[0][0], side)] = got
        return got

    def stays(self, left: bytes, right: bytes) -> bool:
        """No merge across the seam of the two tokens comes before the merges that make them up.

        On equal ranks the leftmost pair merges first: inside ``left`` wins, inside ``right`` loses.
        """
        if not left:
            return True
        got = self.seams.get((left, right))
        if got is None:
            got = True
            ends = self._spine(right, 0)
            for x, gone_x in self._spine(left, 1):
                for y, gone_y in ends:
                    r = self.rank.get((x, y))
                    if r is not None and r < gone_x and r <= gone_y:
                        got = False
                        break
                if not got:
                    break
            if len(self.seams) > 2_000_000:
                self.seams.clear()
            self.seams[(left, right)] = got
        return got

    def _build(self, state: int, byte: int) -> None:
        b = bytes((byte,))
        opened = [(before, n, since + b) for before, n, since in self.states[state] if since + b in self.prefixes]
        last, change = next((since, n + 1) for before, n, since in opened
                            if since in self.tokens and self.stays(before, since))
        moved = tuple((before, n - change, since) for before, n, since in opened) + ((last, 0, b""),)
        to = self.ids.get(moved)
        if to is None:
            to = self.ids[moved] = len(self.states)
            self.states.append(moved)
        if 2 * self.filled > self.mask:
            self._grow(4 * (self.mask + 1))
        self._put(state * 256 + byte, to, change)

    def count(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each piece ``data[start:start + length]``; the pieces run side by side, longest first."""
        if len(self.states) > self.max_states:
            self.reset()
        order = np.argsort(-lengths, kind="stable")
        at, size = starts[order], lengths[order]
        state = np.zeros(len(order), "int64")
        total = np.zeros(len(order), "int32")
        alive = len(order)
        for i in range(int(size[0]) if len(size) else 0):
            alive = int(np.searchsorted(-size[:alive], -i, "left"))
            keys = state[:alive] * 256 + data[at[:alive] + i]
            slot = self._find(keys)
            if (slot < 0).any():
                for key in np.unique(keys[slot < 0]):
                    self._build(int(key >> 8), int(key & 255))
                slot = self._find(keys)
            total[:alive] += self.change[slot]
            state[:alive] = self.to[slot]
        out = np.empty(len(order), "int32")
        out[order] = total
        return out


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 characters stand for
    themselves, the other bytes in order for U+0100 and up."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizer:
    """A compiled byte-level BPE tokenizer file."""

    def __init__(self, content: bytes, max_states: int = MAX_STATES) -> None:
        spec = json.loads(content)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        known = (model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                 and not pre.get("add_prefix_space") and not spec.get("normalizer") and not model.get("ignore_merges")
                 and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"))
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens", []))
        if not known or not plain:
            raise ValueError("only plain byte-level BPE files can be compiled")
        letters = _byte_letters()

        def raw(piece: str) -> bytes:
            return bytes(letters[ch] for ch in piece)

        special = [t["content"] for t in spec.get("added_tokens", [])]
        merges = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        vocab = {raw(k): v for k, v in model["vocab"].items() if k not in special}
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.splitter, self.counter = Splitter(), Counter(vocab, merges, max_states)

    def count_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, tokens) of every text."""
        parts: list[str] = []
        owner: list[int] = []
        n_bytes = np.zeros(len(texts), "int64")
        tokens = np.zeros(len(texts), "int64")
        for i, t in enumerate(texts):
            if self.special is not None and self.special.search(t):
                found = self.special.findall(t)
                n_bytes[i] += sum(len(f.encode()) for f in found)
                tokens[i] += len(found)
                kept = [p for p in self.special.split(t) if p]
            else:
                kept = [t] if t else []
            parts += kept
            owner += [i] * len(kept)
        if not parts:
            return n_bytes, tokens
        sizes = np.fromiter(map(len, parts), "int64", len(parts))
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")
        # texts are told apart by fences, so that a piece never crosses from one into the next
        ends = np.cumsum(sizes)
        fenced = np.insert(codes, ends, 0x10FFFF)
        real = np.ones(len(fenced), bool)
        real[ends + np.arange(len(ends))] = False
        fenced_starts = self.splitter.starts(fenced)
        start = np.flatnonzero(fenced_starts[real])
        width = 1 + (codes >= 0x80).astype("int8") + (codes >= 0x800) + (codes >= 0x10000)
        offset = np.concatenate(([0], np.cumsum(width, dtype="int64")))
        data = np.frombuffer("".join(parts).encode(), "uint8")
        first = offset[start]
        length = np.diff(np.append(first, len(data)))
        counts = self._count_pieces(data, first, length)
        text_of = np.searchsorted(ends, start, "right")
        owners = np.asarray(owner)
        tokens += np.bincount(owners[text_of], counts, len(texts)).astype("int64")
        n_bytes += np.bincount(owners, np.diff(np.concatenate(([0], offset[ends]))), len(texts)).astype("int64")
        return n_bytes, tokens

    def _count_pieces(self, data: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Counts by piece; pieces of up to 16 bytes that are equal run through the counter once."""
        out = np.zeros(len(first), "int64")
        short = np.flatnonzero(length <= 16)
        if len(short):
            padded = np.concatenate([data, np.zeros(16, "uint8")])
            low = np.zeros(len(short), "uint64")
            high = np.zeros(len(short), "uint64")
            at, size = first[short], length[short]
            for i in range(16):
                b = np.where(size > i, padded[at + i], 0).astype("uint64") << np.uint64(8 * (i % 8))
                if i < 8:
                    low |= b
                else:
                    high |= b
            # a piece is its bytes: low, high and length name it exactly
            order = np.lexsort((high, low, size))
            lo, hi, sz = low[order], high[order], size[order]
            new = np.concatenate(([True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]) | (sz[1:] != sz[:-1])))
            group = np.cumsum(new) - 1
            one = order[new]
            counts = self.counter.count(data, at[one], size[one])
            out[short[order]] = counts[group]
        long = np.flatnonzero(length > 16)
        if len(long):
            out[long] = self.counter.count(data, first[long], length[long])
        return out


_COMPILED: dict[int, Tokenizer] = {}


def _compiled(content: bytes, max_states: int) -> Tokenizer:
    """One compiled tokenizer a Python worker: its table grows with what the worker has seen."""
    key = hash((content, max_states))
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Tokenizer(content, max_states)
    return _COMPILED[key]


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", *, limit: int = 512,
                 max_states: int = MAX_STATES) -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` to every row of ``docs``.

    The tokenizer file (a fixed size, known before the run) is read on the driver and broadcast.
    """
    small_batches(docs.sparkSession)
    with open(tokenizer_path, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("n_bytes long, n_tokens long")
    def counted(column: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tok = _compiled(content.value, max_states)
        for texts in column:
            values = ["" if t is None else t for t in texts]
            sizes = np.cumsum([len(t) for t in values])
            done, lo = [], 0
            while lo < len(values):  # a bounded number of characters at a time
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + BATCH_CHARS, "right")))
                done.append(np.stack(tok.count_batch(values[lo:hi]), axis=1))
                lo = hi
            both = np.concatenate(done) if done else np.zeros((0, 2), "int64")
            yield pd.DataFrame({"n_bytes": both[:, 0], "n_tokens": both[:, 1]})

    kept = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    return (docs.withColumn("__count", counted(F.col(text)))
            .select(*kept, "__count.n_bytes", "__count.n_tokens",
                    (F.col("__count.n_tokens") > limit).alias("over_limit")))
