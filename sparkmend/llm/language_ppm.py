"""Language identification by prediction by partial matching (PPM).

Each language has a context tree of bytes up to ``ORDER`` deep: how often each byte followed each context. With
these statistics frozen, a byte's code length in a language is that of its longest known context; where the
byte never followed it, the escape probability (method C: distinct followers / (total + distinct)) is paid and
the next shorter context is asked, down to a smoothed order 0. A text's language is the one with the
shortest code. The trees are compiled into tables: for each known (context, byte) the log probability
in every language with all its escapes resolved, and for each known context its escapes; most bytes of a
text need a single lookup.

Counts are gathered by Spark from the learning rows: at most ``rows_per_language`` different texts a
language, those of smallest hash (a documented bound; None: all of them, as the pipeline learns); a text that many rows hold is learned once. A (context, byte) pair
is kept from two occurrences on. Each language has an equal share of ``max_nodes`` pairs of an order: a pair must reach 1 / share of
its own language's occurrences of the order, so at most ``max_nodes`` pairs of an order are kept whatever the input (that
bounds the broadcast), and a rare language keeps its deep contexts beside a large one. Texts are judged where they are, without a shuffle.

Cases: NULL texts and texts without a letter are ``und`` with score 0, as is every text when nothing can be
learned; ties go to the first language in code-point order; NULL languages are not learned; repeated
rows are judged alike; an empty table gives an empty result; clashing result columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmend.llm.common import small_batches
from sparkmend.llm.text_arrays import HashIndex, batches
from sparkmend.session import cut_lineage, release

ORDER = 4
ROWS_PER_LANGUAGE = 1500
MAX_NODES = 1 << 19
BATCH_BYTES = 2_000_000
JUDGE_BYTES = 500_000  # judged at once, in some 100 times as many bytes
UNKNOWN = "und"
# kinds of bytes: 0 white space, 1 letter, 2 sign that plain words don't hold, 3 any other
_KINDS = np.full(256, 3, "uint8")
_KINDS[[0x20, *range(0x09, 0x0E)]] = 0
_KINDS[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = 1
_KINDS[list(b"0123456789@/=_\\")] = 2


def _grams(data: np.ndarray, order: int) -> np.ndarray:
    """Code of the ``order + 1`` bytes that end at each position (those before the start count as 0)."""
    code = data.astype("uint64")
    for back in range(1, order + 1):
        code[back:] |= data[:-back].astype("uint64") << np.uint64(8 * back)
    return code


def _batch(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts in a row, each text's start, and each byte's place in its text (up to ``ORDER``)."""
    size = np.fromiter(map(len, texts), "int64", len(texts))
    start = np.cumsum(size) - size
    data = np.frombuffer(b"".join(texts), "uint8")
    depth = np.full(len(data), ORDER, "uint8")
    for i in range(ORDER - 1, -1, -1):
        at = start[size > i] + i
        depth[at] = i
    return data, start, depth


def _plain_words(data: np.ndarray, start: np.ndarray, logs: np.ndarray, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: code length in bits of the letters (a-z and all beyond ASCII) of its plain words, and their number of bytes.

    Plain words have no digits or signs of addresses and keys. Each word costs what it costs in its best language,
    so a text of several learned languages costs no more than others. The first ``skip`` bytes don't count.
    """
    kind = _KINDS[data]
    begins = kind == 0
    begins[start] = True
    first = np.flatnonzero(begins)
    counted = (kind == 1) & ~np.repeat(np.maximum.reduceat(kind == 2, first), np.diff(np.append(first, len(data))))
    counted[:skip] = False
    cost = np.add.reduceat(logs * counted[:, None], first, axis=0, dtype="float64").max(axis=1)
    return (-np.add.reduceat(cost, np.searchsorted(first, start)) / np.log(2),
            np.add.reduceat(counted, start, dtype="int64"))


@dataclass
class Model:
    """Languages and, by order, their compiled tables (rows: known pairs or contexts; columns: languages)."""

    languages: list[str]
    base: np.ndarray
    pairs: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]

    def __getstate__(self):
        return (self.languages, self.base, self.pairs, self.contexts)

    def __setstate__(self, state):
        self.languages, self.base, self.pairs, self.contexts = state

    def indexes(self) -> list[tuple[HashIndex, HashIndex]]:
        if not hasattr(self, "_indexes"):
            self._indexes = [(HashIndex(a[0]), HashIndex(b[0])) for a, b in zip(self.pairs, self.contexts)]
        return self._indexes

    def log_probabilities(self, data: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Natural log probability of every byte in every language."""
        out = np.zeros((len(data), len(self.languages)), "float32")
        todo = None
        for order in range(ORDER, 0, -1):
            code = _grams(data, order)
            table, escapes = self.pairs[order - 1][1], self.contexts[order - 1][1]
            pairs, contexts = self.indexes()[order - 1]
            here = np.flatnonzero(depth >= order) if todo is None else todo[depth[todo] >= order]
            at = pairs.find(code[here])
            hit = at >= 0
            out[here[hit]] += table[at[hit]]
            missed = here[~hit]
            seen = contexts.find(code[missed] >> np.uint64(8))
            known = seen >= 0
            out[missed[known]] += escapes[seen[known]]
            shallow = np.flatnonzero(depth < order) if todo is None else todo[depth[todo] < order]
            todo = np.sort(np.concatenate([missed, shallow]))
        out[todo] += self.base[data[todo]]
        return out

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: language, score (posterior under equal priors), and code length (bits) and letter bytes of its plain words."""
        found = [UNKNOWN] * len(texts)
        score, bits, letters = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), "int64")
        use = [i for i, t in enumerate(texts) if t and any(ch.isalpha() for ch in t)] if self.languages else []
        if not use:
            return found, score, bits, letters
        raw = [texts[i].lower().encode() for i in use]
        sizes = np.array([len(r) for r in raw])
        for lo, hi in batches(sizes, JUDGE_BYTES):
            if sizes[lo] > JUDGE_BYTES:  # one very long text: in slices that overlap by a context
                total, plain, many = np.zeros((1, len(self.languages))), np.zeros(1), np.zeros(1, "int64")
                for a in range(0, len(raw[lo]), JUDGE_BYTES):
                    head = min(a, ORDER)
                    data, _, depth = _batch([raw[lo][a - head:a + JUDGE_BYTES]])
                    logs = self.log_probabilities(data, depth)
                    total += logs[head:].sum(0, dtype="float64")
                    cost, n = _plain_words(data, np.zeros(1, "int64"), logs, head)
                    plain += cost
                    many += n
            else:
                data, start, depth = _batch(raw[lo:hi])
                logs = self.log_probabilities(data, depth)
                total = np.add.reduceat(logs, start, axis=0, dtype="float64")
                plain, many = _plain_words(data, start, logs)
            best = total.argmax(1)
            for j, (b, row) in enumerate(zip(best, total)):
                i = use[lo + j]
                found[i] = self.languages[b]
                score[i] = 1.0 / np.exp(np.maximum(row - row[b], -700)).sum()
                bits[i], letters[i] = plain[j], many[j]
        return found, np.clip(score, 0.0, 1.0), bits, letters


def compile_model(languages: list[str], order: np.ndarray, code: np.ndarray, language: np.ndarray,
                  count: np.ndarray) -> Model:
    """Tables of all orders from (order, code of context and byte, language number, count) rows."""
    n = len(languages)
    base = np.ones((256, n))
    zero = order == 0
    np.add.at(base, (code[zero].astype("int64"), language[zero]), count[zero])
    base = np.log(base / base.sum(0, keepdims=True)) if n else base
    pairs, contexts = [], []
    below_keys, below = np.arange(256, dtype="uint64"), base
    for k in range(1, ORDER + 1):
        rows = order == k
        keys, place = np.unique(code[rows], return_inverse=True)
        c = np.zeros((len(keys), n))
        np.add.at(c, (place, language[rows]), count[rows])
        ctx, of = np.unique(keys >> np.uint64(8), return_inverse=True)
        total, kinds = np.zeros((len(ctx), n)), np.zeros((len(ctx), n))
        np.add.at(total, of, c)
        np.add.at(kinds, of, c > 0)
        escape = np.where(total > 0, np.log(np.maximum(kinds, 1) / np.maximum(total + kinds, 1)), 0.0)
        shorter = keys & np.uint64((1 << (8 * k)) - 1)
        lower = below[np.searchsorted(below_keys, shorter)] if len(keys) else np.zeros((0, n))
        table = np.where(c > 0, np.log(np.maximum(c, 1) / np.maximum(total + kinds, 1)[of]), escape[of] + lower)
        pairs.append((keys, table.astype("float32")))
        contexts.append((ctx, escape.astype("float32")))
        below_keys, below = keys, table
    return Model(languages, base.astype("float32"), pairs, contexts)


def gram_counts(texts: DataFrame, text: str, language: str) -> DataFrame:
    """``language, gram_order, code, n``: how often each (context, byte) occurs, counted in batches before the shuffle."""
    def counted_of(name: str, raw: list[bytes]) -> Iterator[pd.DataFrame]:
        for lo, hi in batches(np.array([len(r) for r in raw], "int64"), BATCH_BYTES):
            data, _, depth = _batch(raw[lo:hi])
            for k in range(ORDER + 1):
                code, n = np.unique(_grams(data, k)[depth >= k], return_counts=True)
                yield pd.DataFrame({"language": name, "gram_order": np.int32(k),
                                    "code": code.astype("int64"), "n": n.astype("int64")})

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[str, list[bytes]] = {}
        size = 0
        for p in parts:
            for name, rows in p.groupby(language, sort=True):
                raw = [t.lower().encode() for t in rows[text] if t]
                waiting.setdefault(name, []).extend(raw)
                size += sum(map(len, raw))
            if size > 4 * BATCH_BYTES:  # few large batches send fewer rows; bounded memory
                for name, raw in waiting.items():
                    yield from counted_of(name, raw)
                waiting, size = {}, 0
        for name, raw in waiting.items():
            yield from counted_of(name, raw)

    counted = texts.mapInPandas(count, "language string, gram_order int, code long, n long")
    return counted.groupBy("language", "gram_order", "code").agg(F.sum("n").alias("n"))


def different(rows: DataFrame, text: str, language: str) -> DataFrame:
    """``text, language`` of all different texts of each language, each once however often it occurs."""
    return rows.groupBy(F.col(language), F.xxhash64(text).alias("__h"), F.xxhash64(F.lit(1), text).alias("__g")).agg(
        F.min(text).alias(text)).select(text, language)


def sampled(rows: DataFrame, text: str, language: str, many: int | None) -> DataFrame:
    """``text, language`` of the ``many`` different texts of smallest hash in each language (None: all), each once however often it occurs.

    The hash is cut by its magnitude first: the number of different hashes up to each power of two (a sketch, at most 64
    rows a language) tells which powers hold enough, so only about twice ``many`` hashes of a language are ranked.
    """
    if many is None:
        return different(rows, text, language)
    h = F.col("__h")
    hashed = rows.select(F.col(text).alias("__text"), F.col(language).alias("__language"), F.shiftrightunsigned(F.xxhash64(text), 1).alias("__h"))
    level = F.length(F.bin(h))
    levels = hashed.groupBy("__language", level.alias("level")).agg(F.approx_count_distinct("__h").alias("n"))
    upward = Window.partitionBy("__language").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    # the levels before the one that brings 1.25 x many (the sketch errs by 5%), and that one
    top = (levels.withColumn("below", F.coalesce(F.sum("n").over(upward), F.lit(0))).where(F.col("below") < 1.25 * many)
           .groupBy("__language").agg(F.max("level").alias("top")))
    first = Window.partitionBy("__language").orderBy("__h")
    # top: a row a language; broadcast, as a shuffle by language would bring a language's hashes into one task
    chosen = (hashed.select("__language", "__h").join(F.broadcast(top), "__language").where(level <= F.col("top")).select("__language", "__h").distinct()
              .withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= many).select("__language", "__h"))
    # chosen: at most ``many`` rows a language
    return (hashed.join(F.broadcast(chosen), ["__language", "__h"], "left_semi").groupBy("__language", "__h")
            .agg(F.min("__text").alias(text)).select(text, F.col("__language").alias(language)))


def learn(docs: DataFrame, *, text: str = "text", language: str = "lang",
          allowed: Column | None = None, rows_per_language: int | None = ROWS_PER_LANGUAGE, max_nodes: int = MAX_NODES) -> Model:
    """Context trees of every language among the ``allowed`` rows with a text and a language."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(text).isNotNull() & F.col(language).isNotNull())
    if allowed is not None:
        rows = rows.where(allowed)
    counts = cut_lineage(gram_counts(sampled(rows, text, language, rows_per_language), text, language).where(
        "n >= 2 or gram_order = 0"), "grams")
    totals = counts.groupBy("language", "gram_order").agg(F.sum("n").alias("of_order")).withColumn(
        "languages", F.count("*").over(Window.partitionBy("gram_order")))
    kept = counts.join(F.broadcast(totals), ["language", "gram_order"]).where(
        F.col("n") * max_nodes >= F.col("of_order") * F.col("languages"))
    # at most max_nodes pairs an order: bounded for the driver
    got = kept.select("language", "gram_order", "code", "n").toPandas().sort_values(
        ["language", "gram_order", "code"], kind="stable")
    release(counts)
    languages = sorted(got.language.unique())
    number = {x: i for i, x in enumerate(languages)}
    return compile_model(languages, got.gram_order.to_numpy(), got.code.to_numpy("uint64"),
                         got.language.map(number).to_numpy("int64"), got.n.to_numpy("float64"))


def usual_bits(docs: DataFrame, model: Model, *, text: str = "text", language: str = "lang",
               rows_per_language: int | None = ROWS_PER_LANGUAGE) -> dict[str, float]:
    """Median code length of each language, in bits a letter byte, over texts that the model names rightly; meant for rows that it
    has not learned (a bounded sample by hash: ``rows_per_language``; None: all)."""
    rows = docs.where(F.col(text).isNotNull() & F.col(language).isNotNull())
    known = identify(sampled(rows, text, language, rows_per_language), model, text=text)
    known = known.where((F.col("lang_pred") == F.col(language)) & (F.col("letter_bytes") > 0))
    # one row a language
    return {r.lang_pred: r.usual for r in known.groupBy("lang_pred").agg(
        F.median(F.col("letter_bits") / F.col("letter_bytes")).alias("usual")).collect()}


def foreign(usual: dict[str, float], *, times: float = 3.0, excess: float = 640.0) -> Column:
    """Whether a text is of no learned language: its plain words cost more than ``times`` the usual code length of its
    language, and at least ``excess`` bits more than usual in sum (short texts don't tell; without a usual length none is foreign)."""
    expected = F.lit(None).cast("double")
    for name, bits in usual.items():
        expected = F.when(F.col("lang_pred") == name, F.col("letter_bytes") * bits).otherwise(expected)
    return F.coalesce((F.col("letter_bits") > times * expected) & (F.col("letter_bits") - expected > excess), F.lit(False))


RESULT = {"lang_pred": "string", "score": "double", "letter_bits": "double", "letter_bytes": "long"}


def identify(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1), ``letter_bits`` and ``letter_bytes`` (code length of the plain words; 0 for ``und``) to every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(", ".join(f"{c} {t}" for c, t in RESULT.items()))
    def judged(column: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in column:
            found, *numbers = shared.value.judge(list(texts))
            yield pd.DataFrame(dict(zip(RESULT, (pd.Series(found, dtype="object"), *numbers))))

    kept = [c for c in docs.columns if c not in RESULT]
    # else Spark moves a filter on the result below it and judges every text twice, in two Python processes a task
    return docs.withColumn("__lang", judged.asNondeterministic()(F.col(text))).select(*kept, *[f"__lang.{c}" for c in RESULT])
