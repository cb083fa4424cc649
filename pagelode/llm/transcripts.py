"""Transcript parsing: a hidden Markov model recovers roles, then turns are rendered canonically.

A transcript is a sequence of lines. Each line shows one symbol made of its speaker marker (which
kind of name stands before a colon, or none) and of features of the line (question, length, whether
a blank line stands before it, whether it is the first). States are (role, start or continuation);
Viterbi decoding finds the likeliest sequence, and runs of lines from one start to the next are
turns.

Long transcripts are cut into chunks. A chunk is summed up by the best score from each entering to
each leaving state (a matrix product in which addition stands for multiplication and the maximum
for addition); these small matrices decide the states at the cuts, after which every chunk is
decoded on its own. The result is that of decoding the whole in one piece, and no task holds more
than the matrices of one transcript or the lines of one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from pagelode.llm.shared import Scratch, ship

ROLES = ("system", "user", "assistant")
#: Names before a colon, or in marker brackets, by the role they stand for. The last kind names nobody.
MARKERS = {"system": ("system", "instruction", "instructions", "context"), "user": ("user", "human", "q", "question", "customer", "prompt"), "assistant": ("assistant", "ai", "bot", "a", "answer", "response", "agent")}
KINDS = (*ROLES, "none")
#: States: 2 * role for the first line of a turn, 2 * role + 1 for its other lines.
STATES = 2 * len(ROLES)
#: Features of a symbol besides the marker: question, long, blank line before, first line.
FLAGS = 16
SYMBOLS = len(KINDS) * FLAGS
#: Lines of one chunk.
CHUNK = 2048
LONG = 160
_NAMES = "|".join(sorted((n for ns in MARKERS.values() for n in ns), key=lambda n: (-len(n), n)))
#: One line that shows something, after the blank lines that stand before it. Possessive, so that it takes one pass.
UNIT = r"(?:[^\S\n]*+\n)*+[^\S\n]*+\S[^\n]*+"
PATTERN = rf"(?i)^\s*(?:<\|({_NAMES})\|>|\[({_NAMES})\]:?|({_NAMES})\s?:)\s*"


def marker(line: Column) -> Column:
    """Name of the speaker marker at the start of a line in lower case, or an empty text."""
    return F.lower(F.concat(*(F.coalesce(F.regexp_extract(line, PATTERN, i), F.lit("")) for i in (1, 2, 3))))


def symbols(lines: DataFrame) -> DataFrame:
    """Add `symbol` to lines (line, blank_before: boolean, pos: 0 for the first)."""
    name = marker(F.col("line"))
    kind = F.lit(KINDS.index("none"))
    for i, role in enumerate(ROLES):
        kind = F.when(name.isin(*MARKERS[role]), i).otherwise(kind)
    flag = lambda c, n: F.when(c, n).otherwise(0)
    return lines.withColumn("symbol", kind * FLAGS + flag(F.col("line").rlike(r"\?\s*$"), 8) + flag(F.length("line") > LONG, 4) + flag(F.col("blank_before"), 2) + flag(F.col("pos") == 0, 1))


class Model:
    """Log probabilities of first states, of steps and of symbols."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit = start, step, emit

    def scores(self, symbols: np.ndarray) -> np.ndarray:
        return self.emit[:, symbols].T


def estimate(counts: dict[tuple[str, int, int], float]) -> Model:
    """Smoothed log frequencies from counts ("start", state, 0), ("step", state, state) and ("emit", state, symbol).

    A symbol's probability is that of its marker and of its flags given the state, so that unseen
    combinations keep sensible scores. Steps that no transcript can make (a continuation under
    another role) stay impossible.
    """
    start, step = np.full(STATES, 0.5), np.full((STATES, STATES), 0.5)
    kind, flags = np.full((STATES, len(KINDS)), 0.5), np.full((STATES, FLAGS), 0.5)
    for (what, a, b), n in counts.items():
        if what == "start":
            start[a] += n
        elif what == "step":
            step[a, b] += n
        else:
            kind[a, b // FLAGS] += n
            flags[a, b % FLAGS] += n
    start[1::2] = 0
    for a in range(STATES):
        for b in range(1, STATES, 2):
            if a // 2 != b // 2:
                step[a, b] = 0
    with np.errstate(divide="ignore"):
        emit = np.log(kind / kind.sum(1, keepdims=True))[:, :, None] + np.log(flags / flags.sum(1, keepdims=True))[:, None, :]
        return Model(np.log(start / start.sum()), np.log(step / step.sum(1, keepdims=True)), emit.reshape(STATES, SYMBOLS))


def viterbi(step: np.ndarray, scores: np.ndarray, entry: np.ndarray, last: int | None = None) -> np.ndarray:
    """Likeliest states for the scores of each line; `entry` scores the first line's states, `last` fixes the final one.

    Ties go to the state with the smaller number.
    """
    best = entry + scores[0]
    back = np.zeros((len(scores), STATES), np.int8)
    for t in range(1, len(scores)):
        via = best[:, None] + step
        back[t] = via.argmax(0)
        best = via.max(0) + scores[t]
    out = np.zeros(len(scores), np.int64)
    out[-1] = int(best.argmax()) if last is None else last
    for t in range(len(scores) - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def passage(step: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Best score of a chunk from each state of its first line to each state of its last line."""
    m = np.full((STATES, STATES), -np.inf)
    np.fill_diagonal(m, scores[0])
    for s in scores[1:]:
        m = (m[:, :, None] + step[None]).max(1) + s
    return m


def crossings(model: Model, passages: list[np.ndarray]) -> list[tuple[int, int]]:
    """First and last state of every chunk of one transcript on the likeliest path."""
    ahead, entered = model.start, []
    for m in passages:
        entered.append(ahead)
        ahead = ((ahead[:, None] + m).max(0)[:, None] + model.step).max(0)
    out, last = [], None
    for m, entry in zip(reversed(passages), reversed(entered)):
        through = entry[:, None] + m
        if last is None:
            last = int(through.max(0).argmax())
        first = int(through[:, last].argmax())
        out.append((first, last))
        if len(out) < len(passages):
            k = len(passages) - len(out) - 1
            last = int(((entered[k][:, None] + passages[k]).max(0) + model.step[:, first]).argmax())
    return out[::-1]


def counted(lines: DataFrame) -> dict[tuple[str, int, int], float]:
    """Counts for `estimate` from lines with a known `state`: at most a few hundred numbers reach the driver."""
    w = Window.partitionBy("conv", "chunk").orderBy("pos")
    rows = lines.withColumn("before", F.lag("state").over(w))
    parts = [
        rows.filter("pos = 0").select(F.lit("start").alias("what"), F.col("state").alias("a"), F.lit(0).alias("b")),
        rows.filter("before IS NOT NULL").select(F.lit("step").alias("what"), F.col("before").alias("a"), F.col("state").alias("b")),
        rows.select(F.lit("emit").alias("what"), F.col("state").alias("a"), F.col("symbol").alias("b")),
    ]
    return {(r["what"], r["a"], r["b"]): float(r["n"]) for r in parts[0].union(parts[1]).union(parts[2]).groupBy("what", "a", "b").agg(F.count(F.lit(1)).alias("n")).collect()}


def decode(lines: DataFrame, model: Model, scratch: Scratch) -> DataFrame:
    """(conv, chunk, pos, state) for lines (conv, chunk, pos, symbol); chunk = pos div CHUNK."""
    ship(lines.sparkSession)
    chunks = scratch.cut(lines.groupBy("conv", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "symbol"))), lambda x: x["symbol"]).alias("symbols")))
    shared = lines.sparkSession.sparkContext.broadcast(model)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            made = [passage(m.step, m.scores(np.array(x))).ravel().tolist() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.list_(pa.float64()))], names=["conv", "chunk", "passage"])

    def cross(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group["conv"].to_pylist(), group["chunk"].to_pylist(), group["passage"].to_pylist()))
        out: list[tuple] = []
        at = 0
        while at < len(rows):
            end = at
            while end < len(rows) and rows[end][0] == rows[at][0]:
                end += 1
            states = crossings(shared.value, [np.array(r[2]).reshape(STATES, STATES) for r in rows[at:end]])
            out += [(r[0], r[1], first, last) for r, (first, last) in zip(rows[at:end], states)]
            at = end
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["conv", "chunk", "first", "last"])

    many = chunks.groupBy("conv").agg(F.max("chunk").alias("top")).filter("top > 0").select("conv")
    passages = chunks.join(many, "conv", "left_semi").select("conv", "chunk", "symbols").mapInArrow(sum_up, "conv long, chunk long, passage array<double>")
    cuts = passages.withColumn("part", F.pmod(F.xxhash64("conv"), F.lit(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))))).groupBy("part").applyInArrow(cross, "conv long, chunk long, first int, last int")

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            made = []
            for x, first, last in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                entry = m.start
                if first is not None:
                    entry = np.full(STATES, -np.inf)
                    entry[first] = 0.0
                made.append(viterbi(m.step, m.scores(np.array(x)), entry, last).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.list_(pa.int32()))], names=["conv", "chunk", "states"])

    found = chunks.join(cuts, ["conv", "chunk"], "left").select("conv", "chunk", "symbols", "first", "last").mapInArrow(paths, "conv long, chunk long, states array<int>")
    each = found.select("conv", "chunk", F.posexplode("states").alias("k", "state"))
    return each.select("conv", "chunk", (F.col("chunk") * CHUNK + F.col("k")).alias("pos"), "state")


def turns(lines: DataFrame, states: DataFrame) -> DataFrame:
    """(conv, start, role, content, rendered) of every recovered turn; start is its first line.

    Turns are numbered by the running count of first lines, carried over chunks as offsets, so a
    long transcript is never in one task. The marker of the first line is taken off with the blank
    lines before it; blank lines inside a turn stay. A turn is rendered as <|role|>, its lines and <|end|>.
    """
    rows = lines.join(states.select("conv", "pos", "state"), ["conv", "pos"])
    first = (F.col("state") % 2 == 0).cast("long")
    w = Window.partitionBy("conv", "chunk").orderBy("pos")
    per = rows.groupBy("conv", "chunk").agg(F.sum(first).alias("n"))
    before = per.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = rows.withColumn("own", F.sum(first).over(w)).join(before.select("conv", "chunk", "base"), ["conv", "chunk"]).withColumn("turn", F.col("base") + F.col("own") - 1)
    text = F.concat(F.when(first == 1, F.regexp_replace("line", PATTERN, "")).otherwise(F.concat("lead", "line")), "tail")
    role = F.element_at(F.array(*map(F.lit, ROLES)), (F.floor(F.col("state") / 2) + 1).cast("int"))
    out = numbered.groupBy("conv", "turn").agg(F.min("pos").alias("start"), F.first(role).alias("role"), F.array_sort(F.collect_list(F.struct("pos", text.alias("t")))).alias("x"))
    out = out.withColumn("content", F.array_join(F.transform("x", lambda x: x["t"]), ""))
    return out.select("conv", "turn", "start", "role", "content", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("content"), F.lit("\n<|end|>")).alias("rendered"))


def lines_of(df: DataFrame, text: str = "text", order: str = "turn", conv: str = "conv_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Lines of transcripts given in pieces (conv, order, text): conv, chunk, pos, line, blank_before, piece and carried columns.

    Blank lines are not lines themselves: `lead` holds the line breaks and blank lines before a line
    and `tail` the white space after the last line of a piece, so a turn's content is its text to
    the character. `blank_before` is read from the text alone. Pieces follow each other after one
    line break, and pieces without a visible character have no line. Null texts count as empty;
    pieces that tie in `order` follow their text. Positions are counted with offsets per block of
    pieces, so a long transcript is spread over tasks. Rows with a null conversation or order are left out.
    """
    width = CHUNK
    pieces = df.filter(F.col(conv).isNotNull() & F.col(order).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(order).cast("long").alias("piece"), F.coalesce(F.col(text), F.lit("")).alias("t"), *carry).withColumn("block", F.floor(F.col("piece") / width))
    body = F.rtrim("t", F.lit(" \t\n\x0b\f\r"))
    pieces = pieces.withColumn("ls", F.regexp_extract_all(body, F.lit(UNIT), F.lit(0))).withColumn("n", F.size("ls")).withColumn("rest", F.expr("substring(t, length(array_join(ls, '')) + 1)"))
    per = pieces.groupBy("conv", "block").agg(F.sum("n").alias("total"))
    base = per.withColumn("base", F.coalesce(F.sum("total").over(Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("total")
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("conv", "block").orderBy("piece", F.xxhash64("t"), "t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = pieces.withColumn("ahead", ahead).join(base, ["conv", "block"]).select("conv", "piece", "ahead", "base", "n", "rest", *carry, F.posexplode("ls").alias("k", "x"))
    pos = F.col("base") + F.col("ahead") + F.col("k")
    line = F.substring_index("x", "\n", -1)
    placed = placed.withColumn("pos", pos).withColumn("line", line).withColumn("lead", F.expr("concat(IF(k = 0, '\n', ''), left(x, length(x) - length(line)))"))
    blank = F.length(F.regexp_replace("lead", "[^\n]", "")) > 1
    tail = F.when(F.col("k") == F.col("n") - 1, F.col("rest")).otherwise("")
    return placed.select("conv", "pos", F.floor(F.col("pos") / width).alias("chunk"), "line", "lead", tail.alias("tail"), blank.alias("blank_before"), "piece", (F.col("k") == 0).alias("opens"), *carry)



def parse(lines: DataFrame, model: Model, scratch: Scratch) -> DataFrame:
    """Recover the turns of transcripts (lines as `lines_of` gives them)."""
    seen = scratch.cut(symbols(lines).select("conv", "chunk", "pos", "line", "lead", "tail", "symbol"))
    return turns(seen, decode(seen, model, scratch))
