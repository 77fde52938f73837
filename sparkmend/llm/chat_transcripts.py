"""Chat formatting: roles of raw transcripts by a hidden Markov model, then canonical turns.

A transcript is a table of lines. A line's hidden state is a role and whether it begins a turn or goes on in it. What is seen of a
line is its speaker marker ("User:", "### Response:", "<|assistant|>", "Q:", ...), whether it is blank, whether it asks, and its length.
Start, transition and feature probabilities are counted from labelled conversations (add-one smoothing; a few hundred
numbers). Viterbi finds the likeliest states, so a turn without a marker, or a marker word inside a text, is put right by
what stands around it. Each line is then rendered in a canonical form (``<|role|>`` before a turn, ``<|end|>`` after it).

A transcript may be of any length, one may hold a third of all lines. Its lines are cut into chunks of ``CHUNK_TURNS`` turns; the
best scores from each state before a chunk to each state at its end are a max-plus matrix, and such matrices compose. They
are composed over chunks, then over groups of ``GROUP_CHUNKS`` chunks; then the boundary states of the best path
go down the same two levels, and every chunk is decoded on its own between its two boundary states.

Cases: NULL and empty texts are one blank line; rows without an id are transcripts of their own; a NULL turn counts as turn 0;
unknown roles aren't learned; repeated rows are repeated lines, in an order fixed by their text; ties go to the smaller state; without labelled
rows all probabilities are even; an empty table gives an empty result; other columns play no part.
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

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # 2 * role begins a turn of the role, 2 * role + 1 goes on in it
CHUNK_TURNS, GROUP_CHUNKS = 64, 1024

# The names that speaker markers use, by role.
MARKER_NAMES = {
    "system": ("system", "context"),
    "user": ("user", "human", "customer", "instruction", "question", "q"),
    "assistant": ("assistant", "ai", "bot", "model", "response", "answer", "a"),
}
_NAMES = "|".join(n for names in MARKER_NAMES.values() for n in names)
# a name at the line's beginning, in brackets or before a colon
MARKER = rf"(?i)^\s*(?:#+\s*({_NAMES})\s*:?|<\|({_NAMES})\|>|\[({_NAMES})\]:?|({_NAMES})\s*:)\s*"
FEATURES = {"marker": 4, "blank": 2, "asks": 2, "length": 8}


def features(line: Column) -> dict[str, Column]:
    """What is seen of a line, as small numbers."""
    name = F.lower(F.concat(*[F.regexp_extract(line, MARKER, i) for i in range(1, 5)]))
    marker = F.lit(0)
    for k, role in enumerate(ROLES, 1):
        marker = F.when(name.isin(*MARKER_NAMES[role]), k).otherwise(marker)
    body = F.trim(line)
    return {"marker": marker, "blank": (body == "").cast("int"), "asks": F.endswith(body, F.lit("?")).cast("int"),
            "length": F.least(F.lit(7), F.floor(F.log2(F.length(body) + F.lit(1)))).cast("int")}


def lines(turns: DataFrame, *, key: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """The lines of a table of texts: ``conv, turn, same, line, content`` (``same`` orders repeated turns)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    conv = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("row "), F.xxhash64(*turns.columns).cast("string")))
    rest = [c for c in turns.columns if c not in (key, turn, text, "conv", "same", "line", "content")]
    return turns.select(conv.alias("conv"), F.coalesce(F.col(turn).cast("long"), F.lit(0)).alias("turn"),
                        F.xxhash64(*turns.columns).alias("same"), *rest,
                        F.posexplode(F.split(whole, "\n", -1)).alias("line", "content"))


@dataclass(frozen=True)
class Model:
    """Log probabilities: start, transition (from, to), and by feature (state, value)."""

    start: np.ndarray
    step: np.ndarray
    seen: dict[str, np.ndarray]


def learn(labelled: DataFrame, role: str = "role") -> Model:
    """Count the model from ``lines`` that have a role; every count is a partial aggregation over small keys."""
    number = F.coalesce(*[F.when(F.lower(F.trim(F.col(role))) == r, F.lit(k)) for k, r in enumerate(ROLES)])
    rows = labelled.withColumn("__role", number).where("__role is not null")
    state = F.col("__role") * 2 + (F.col("line") > 0).cast("int")
    seen = {}
    counted = rows.select(state.alias("state"), *[c.alias(f) for f, c in features(F.col("content")).items()])
    for name, values in FEATURES.items():
        seen[name] = _logs(counted.groupBy("state", name).count(), (STATES, values))
    step = np.zeros((STATES, STATES))
    turns = rows.groupBy("conv", "turn", "same").agg(F.max("__role").alias("r"), F.count("*").alias("n"))
    turns = cut_lineage(turns, "turns")
    for r in turns.groupBy("r").agg(F.count_if(F.col("n") > 1).alias("more"), F.sum(F.greatest(F.col("n") - 2, F.lit(0))).alias("on")).collect():
        step[2 * r.r, 2 * r.r + 1] += r.more
        step[2 * r.r + 1, 2 * r.r + 1] += r.on
    after = turns.select("conv", (F.col("turn") - 1).alias("turn"), F.col("r").alias("next"))
    for r in turns.join(after, ["conv", "turn"]).groupBy("r", (F.col("n") > 1).cast("int").alias("long"), "next").count().collect():
        step[2 * r.r + r.long, 2 * r.next] += r["count"]
    first = turns.groupBy("conv").agg(F.min(F.struct("turn", "same", "r")).alias("t")).groupBy("t.r").count()
    start = np.full(STATES, 0.01)
    start[0::2] += 1
    for r in first.collect():
        start[2 * r.r] += r["count"]
    allowed = np.full((STATES, STATES), 1e-4)
    allowed[:, 0::2] = 1
    for k in range(len(ROLES)):
        allowed[2 * k:2 * k + 2, 2 * k + 1] = 1
    step += allowed
    return Model(np.log(start / start.sum()), np.log(step / step.sum(1, keepdims=True)), seen)


def _logs(counts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    table = np.ones(shape)
    for s, v, n in counts.collect():
        table[s, v] += n
    return np.log(table / table.sum(1, keepdims=True))


def _compose(matrices: list[np.ndarray]) -> np.ndarray:
    total = matrices[0]
    for m in matrices[1:]:
        total = (total[:, :, None] + m[None, :, :]).max(axis=1)
    return total


def _boundaries(first: np.ndarray, matrices: list[np.ndarray], last: int | None) -> list[int]:
    """States before and after each matrix on the best path from the score vector ``first`` to ``last`` (None: the best)."""
    scores = [first]
    for m in matrices:
        scores.append((scores[-1][:, None] + m).max(axis=0))
    states = [int(scores[-1].argmax()) if last is None else last]
    for v, m in zip(scores[-2::-1], matrices[::-1]):
        states.append(int((v + m[:, states[-1]]).argmax()))
    return states[::-1]


def _fixed(state: int) -> np.ndarray:
    v = np.full(STATES, -np.inf)
    v[state] = 0.0
    return v


def _line_matrices(model: Model, seen: np.ndarray, opens: bool) -> list[np.ndarray]:
    """For each line, the score from each state before it to each of its states; the first line of a transcript has no state before."""
    emit = sum(model.seen[f][:, seen[:, k]] for k, f in enumerate(FEATURES)).T
    out = [model.step + e for e in emit]
    if opens:
        out[0] = np.tile(model.start + emit[0], (STATES, 1))
    return out


def decode(rows: DataFrame, model: Model) -> DataFrame:
    """``conv, turn, same, line, content, state`` of every line, on the likeliest path of its transcript."""
    small_batches(rows.sparkSession)
    at = ["conv", "grp", "chunk"]
    chunk = F.floor(F.col("turn") / CHUNK_TURNS).cast("long")
    first = rows.groupBy("conv").agg(F.min(chunk).alias("first"))
    seen = F.array(*[c.cast("int") for c in features(F.col("content")).values()])
    packed = (rows.withColumn("chunk", chunk).withColumn("grp", F.floor(F.col("chunk") / GROUP_CHUNKS).cast("long"))
              .groupBy(*at).agg(F.sort_array(F.collect_list(F.struct("turn", "same", "line", "content", seen.alias("seen")))).alias("rows"))
              .join(first, "conv").withColumn("opens", F.col("chunk") == F.col("first")))
    packed = cut_lineage(packed.drop("first"), "chunks")

    def matrices(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            m = [_compose(_line_matrices(model, np.array([list(s) for s in x]), o)).ravel() for x, o in zip(p.seen, p.opens)]
            yield pd.DataFrame({"conv": p.conv, "grp": p.grp, "chunk": p.chunk, "m": m})

    def grouped(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            m = [_compose([np.reshape(v, (STATES, STATES)) for v in vs]).ravel() for vs in p.m]
            yield pd.DataFrame({"conv": p.conv, "grp": p.grp, "m": m})

    def top(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for c, g, vs in zip(p.conv, p.grp, p.m):
                s = _boundaries(np.zeros(STATES), [np.reshape(v, (STATES, STATES)) for v in vs], None)
                yield pd.DataFrame({"conv": c, "grp": list(g), "before": s[:-1], "after": s[1:]})

    def down(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for c, g, k, vs, a, b in zip(p.conv, p.grp, p.chunk, p.m, p.before, p.after):
                s = _boundaries(_fixed(a), [np.reshape(v, (STATES, STATES)) for v in vs], int(b))
                yield pd.DataFrame({"conv": c, "grp": g, "chunk": list(k), "before": s[:-1], "after": s[1:]})

    def paths(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            s = [_boundaries(_fixed(a), _line_matrices(model, np.array([list(v) for v in x]), o), int(b))[1:]
                 for x, o, a, b in zip(p.seen, p.opens, p.before, p.after)]
            yield pd.DataFrame({"conv": p.conv, "grp": p.grp, "chunk": p.chunk, "states": s})

    by_chunk = cut_lineage(packed.select(*at, F.col("rows.seen").alias("seen"), "opens").mapInPandas(
        matrices, "conv string, grp long, chunk long, m array<double>"), "matrices")
    in_group = by_chunk.groupBy("conv", "grp").agg(F.sort_array(F.collect_list(F.struct("chunk", "m"))).alias("c")).select(
        "conv", "grp", F.col("c.chunk").alias("chunk"), F.col("c.m").alias("m"))
    by_group = in_group.select("conv", "grp", "m").mapInPandas(grouped, "conv string, grp long, m array<double>")
    whole = by_group.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("grp", "m"))).alias("c")).select(
        "conv", F.col("c.grp").alias("grp"), F.col("c.m").alias("m"))
    ends = whole.mapInPandas(top, "conv string, grp long, before int, after int")
    ends = in_group.join(ends, ["conv", "grp"]).mapInPandas(down, "conv string, grp long, chunk long, before int, after int")
    states = packed.select(*at, F.col("rows.seen").alias("seen"), "opens").join(ends, at).mapInPandas(
        paths, "conv string, grp long, chunk long, states array<int>")
    return packed.join(states, at).select("conv", "chunk", F.posexplode(F.arrays_zip("rows", "states")).alias("place", "r")).select(
        "conv", "chunk", "place", "r.rows.turn", "r.rows.same", "r.rows.line", "r.rows.content", F.col("r.states").alias("state"))


def render(decoded: DataFrame) -> DataFrame:
    """``conv, turn, line, turn_no, role, rendered``: lines in canonical form, turns numbered from 0 in each transcript."""
    begins = (F.col("state") % 2 == 0).cast("long")
    rows = cut_lineage(decoded.withColumn("begins", begins), "states")
    # one row a chunk: turns before it, and whether the next chunk goes on with its last turn
    along = Window.partitionBy("conv").orderBy("chunk")
    chunks = (rows.groupBy("conv", "chunk").agg(F.sum("begins").alias("n"), F.min_by("begins", "place").alias("opens"))
              .withColumn("turns_before", F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("next_opens", F.lead("opens").over(along)))
    inside = Window.partitionBy("conv", "chunk").orderBy("place")
    rows = (rows.join(chunks.select("conv", "chunk", "turns_before", "next_opens"), ["conv", "chunk"])
            .withColumn("turn_no", F.greatest(F.lit(0), F.col("turns_before") + F.sum("begins").over(inside) - 1))
            .withColumn("follows", F.coalesce(F.lead("begins").over(inside), F.col("next_opens"), F.lit(1))))
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), (F.col("state") / 2).cast("int") + 1)
    body = F.when(F.col("begins") == 1, F.regexp_replace("content", MARKER, "")).otherwise(F.col("content"))
    text = F.concat(F.when(F.col("begins") == 1, F.concat(F.lit("<|"), role, F.lit("|>\n"))).otherwise(""), body,
                    F.when(F.col("follows") == 1, F.lit("\n<|end|>")).otherwise(""))
    return rows.select("conv", "turn", "same", "line", "turn_no", role.alias("role"), text.alias("rendered"))


# Ways in which raw transcripts name their speakers (system, user, assistant).
STYLES = (("System: ", "User: ", "Assistant: "), ("Context: ", "Human: ", "AI: "), ("### System:\n", "### Instruction:\n", "### Response:\n"),
          ("<|system|> ", "<|user|> ", "<|assistant|> "), ("[SYSTEM] ", "[USER] ", "[ASSISTANT] "), ("System: ", "Q: ", "A: "))


def raw_transcripts(turns: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                    silent_percent: int = 15) -> DataFrame:
    """Turns as raw transcripts hold them: a marker in one of several styles (one a transcript) before the text instead of a
    role. ``silent_percent`` of the turns (by hash) have no marker."""
    style = F.pmod(F.xxhash64(F.lit("style"), F.col(key)), F.lit(len(STYLES))).cast("int")
    table = F.array(*[F.array(*[F.lit(m) for m in s]) for s in STYLES])
    number = F.coalesce(*[F.when(F.lower(F.trim(F.col(role))) == r, F.lit(k)) for k, r in enumerate(ROLES)])
    silent = F.pmod(F.xxhash64(F.lit("silent"), F.col(key), F.col(turn)), F.lit(100)) < silent_percent
    marker = F.when(silent | number.isNull(), F.lit("")).otherwise(F.element_at(F.element_at(table, style + 1), number + 1))
    return turns.withColumn(text, F.concat(F.coalesce(marker, F.lit("")), F.coalesce(F.col(text), F.lit(""))))
