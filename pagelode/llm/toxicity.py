"""Toxicity by a convolutional text classifier that is trained and run in numpy.

Words have hashed embeddings (the word and its beginnings share rows, so that inflected forms help
each other), filters of several widths slide over them, each filter keeps its maximum over the
whole text, and a logistic layer scores these maxima. The decision threshold is calibrated by
language: a text's language is read from the text itself, and its score is shifted so that 0.5 is
the best threshold of that language on held-back training rows. All labelled rows take part: partitions
learn side by side and their networks are averaged after every epoch.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.llm import langid
from pagelode.llm.running import running
from pagelode.llm.shared import Scratch, ship

ROWS = 1 << 17
DEPTH = 6
WIDTHS = (1, 2, 3)
FILTERS = 6
#: Beginnings of a word, in characters, that have rows of their own.
PREFIXES = (3, 4, 5)
PARTS = 1 + len(PREFIXES)
#: Embedding rows that are added up or averaged at once.
BLOCK = 2048
#: Texts that one partition learns from in an epoch, about.
ROWS_A_PART = 4000
#: Fewest and most epochs; between them, as many as give ENOUGH_STEPS steps.
EPOCHS = (1, 5)
ENOUGH_STEPS = 30_000
#: Words of a text that are scored at once; neighbouring runs overlap by the widest filter less one.
RUN = 100_000
MEMO_WORDS = 300_000
_WORD = re.compile(r"\w+")


class Words(dict):
    """Word -> its embedding rows, packed; starts anew when full."""

    def __missing__(self, word: str) -> bytes:
        rows = [xxhash.xxh32_intdigest(p) % ROWS for p in (f"={word}", *(f"{n}{word[:n]}" for n in PREFIXES))]
        out = np.array(rows, "<u4").tobytes()
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = out
        return out


_WORDS = Words()


def rows_of(text: str | None) -> np.ndarray:
    """Embedding rows (words x parts) of a whole text."""
    return np.frombuffer(b"".join(map(_WORDS.__getitem__, _WORD.findall((text or "").lower()))), "<u4").reshape(-1, PARTS)


class Network:
    """Embeddings, filters and the logistic layer."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.05, (ROWS, DEPTH)).astype(np.float32)
        self.kernels = [rng.normal(0, 0.4, (w, DEPTH, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.bias = np.float32(0)

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximum of each filter over the text and where it is; missing words at the end count as zero vectors."""
        best, where = np.full(len(self.out), -np.inf, np.float32), np.zeros(len(self.out), np.int64)
        widest = max(WIDTHS)
        for at in range(0, max(len(rows), 1), RUN):
            part = rows[at : at + RUN + widest - 1]
            x = np.zeros((len(part) + widest, DEPTH), np.float32)
            for k in range(PARTS):
                x[: len(part)] += self.embed[part[:, k]]
            n = max(min(RUN, len(part)), 1)
            for i, (w, kernel) in enumerate(zip(WIDTHS, self.kernels)):
                y = x[:n] @ kernel[0]
                for j in range(1, w):
                    y += x[j : j + n] @ kernel[j]
                top = y.argmax(0)
                value = y[top, np.arange(FILTERS)]
                s = slice(i * FILTERS, (i + 1) * FILTERS)
                better = value > best[s]
                best[s] = np.where(better, value, best[s])
                where[s] = np.where(better, top + at, where[s])
        return best, where

    def logit(self, rows: np.ndarray) -> float:
        return float(np.tanh(self.pooled(rows)[0]) @ self.out + self.bias)


class Learner:
    """A network with the sums of squared gradients that AdaGrad divides by."""

    def __init__(self, net: Network, rate: float = 0.05):
        self.net, self.rate = net, rate
        self.embed = np.full(ROWS, 0.1, np.float32)
        self.out = np.full_like(net.out, 0.1)
        self.kernels = [np.full_like(k, 0.1) for k in net.kernels]
        self.bias = 0.1

    def prime(self, seen: np.ndarray, n: np.ndarray) -> None:
        """Begin the first embedding dimension at the smoothed log odds of each row's presence, so that rare words need few epochs.

        `seen` (2 x ROWS) counts the texts of each class that have a row, `n` the texts of each class.
        """
        net = self.net
        odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
        odds[seen.sum(0) < 2] = 0
        net.embed[:, 0] = np.clip(odds, -1, 4) / PARTS
        for kernel in net.kernels:
            kernel[0, 0, : FILTERS // 2] = np.abs(kernel[0, 0, : FILTERS // 2]) + 0.3
        for i in range(len(WIDTHS)):
            net.out[i * FILTERS : i * FILTERS + FILTERS // 2] = np.abs(net.out[i * FILTERS : i * FILTERS + FILTERS // 2])

    def step(self, rows: np.ndarray, y: int, weight: float, touched: np.ndarray) -> None:
        """One step of gradient descent on logistic loss; only the words at the maxima get gradients, and are marked as touched."""
        net, rate = self.net, self.rate
        top, where = net.pooled(rows)
        h = np.tanh(top)
        z = float(h @ net.out + net.bias)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        if abs(g) < 1e-3:
            return
        back = g * net.out * (1 - h * h)
        grad = g * h
        self.out += grad * grad
        net.out -= (rate * grad / np.sqrt(self.out)).astype(np.float32)
        self.bias += g * g
        net.bias -= np.float32(rate * g / np.sqrt(self.bias))
        for k, w in enumerate(WIDTHS):
            kernel, b = net.kernels[k], back[k * FILTERS : (k + 1) * FILTERS]
            at = where[k * FILTERS : (k + 1) * FILTERS, None] + np.arange(w)
            f, j = np.nonzero((np.abs(b) >= 1e-5)[:, None] & (at < len(rows)))
            own = rows[at[f, j]]
            change = np.zeros_like(kernel)
            change[j, :, f] = b[f, None] * net.embed[own].sum(1)
            step = b[f, None] * kernel[j, :, f]
            np.add.at(self.embed, own, (step * step).sum(1)[:, None])
            np.add.at(net.embed, own, -rate * step[:, None] / np.sqrt(self.embed[own])[:, :, None])
            touched[own] = True
            self.kernels[k] += change * change
            kernel -= rate * change / np.sqrt(self.kernels[k])

    def dense(self) -> np.ndarray:
        """All that every text changes, as one vector."""
        return np.concatenate([np.ravel(x) for x in (self.net.out, self.net.bias, self.out, self.bias, *self.net.kernels, *self.kernels)]).astype(np.float64)

    def set_dense(self, v: np.ndarray) -> None:
        net, at = self.net, 0

        def take(shape: tuple) -> np.ndarray:
            nonlocal at
            n = int(np.prod(shape, dtype=int))
            at += n
            return v[at - n : at].reshape(shape).astype(np.float32)

        net.out, net.bias = take(net.out.shape), np.float32(take(()))
        self.out, self.bias = take(self.out.shape), float(take(()))
        net.kernels = [take(k.shape) for k in net.kernels]
        self.kernels = [take(k.shape) for k in self.kernels]


def presence(rows: DataFrame) -> np.ndarray:
    """(2 x ROWS) in how many texts of each class each embedding row occurs, counted where the texts are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, ROWS), np.int64)
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                seen[y, np.unique(rows_of(text))] += 1
        parts = np.split(seen, ROWS // BLOCK, axis=1)
        yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(parts)), pa.int32()), "seen": [p.tobytes() for p in parts]})

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in t.column("seen").to_pylist())
        return pa.table({"block": t.column("block").slice(0, 1), "seen": [total.tobytes()]})

    kind = "block int, seen binary"
    got = rows.select("text", "y").mapInArrow(count, kind).groupBy("block").applyInArrow(add, kind).collect()  # ROWS / BLOCK rows
    seen = np.zeros((2, ROWS), np.int64)
    for r in got:
        seen[:, r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["seen"], np.int64).reshape(2, -1)
    return seen


def pass_over(learner: Learner, rows: DataFrame, parts: int, turn: int, weight: dict[int, float]) -> None:
    """One epoch: each of `parts` partitions goes on from the same network over its own texts, then they are averaged.

    An embedding row is the mean over the partitions that changed it; the layers are the mean over all, weighed by
    texts. Averages are formed by blocks of embedding rows, so the driver gets one network whatever the number of partitions.
    """
    shared = rows.sparkSession.sparkContext.broadcast(learner)
    dealt = rows.select("id", "text", "y").repartition(parts, "id").sortWithinPartitions(F.xxhash64("id", F.lit(turn)), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, touched, n = copy.deepcopy(shared.value), np.zeros(ROWS, bool), 0
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                own.step(rows_of(text), y, weight[y], touched)
                n += 1
        if not n:
            return
        at = np.flatnonzero(touched)
        blocks = np.unique(at // BLOCK)
        made = {-1: (b"", own.dense().tobytes())}
        for k in blocks:
            ids = at[at // BLOCK == k]
            made[int(k)] = ((ids % BLOCK).astype(np.int32).tobytes(), np.column_stack([own.net.embed[ids], own.embed[ids]]).astype(np.float64).tobytes())
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({
            "block": pa.array(list(made), pa.int32()), "part": pa.array([part] * len(made), pa.int32()), "n": pa.array([n] * len(made), pa.int64()),
            "ids": [x[0] for x in made.values()], "mean": [x[1] for x in made.values()]})

    def merge(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        rows_in = sorted(t.to_pylist(), key=lambda r: r["part"])
        if block < 0:
            total = sum(r["n"] * np.frombuffer(r["mean"]) for r in rows_in)
            ids, mean = b"", total / sum(r["n"] for r in rows_in)
        else:
            sums, times = np.zeros((BLOCK, DEPTH + 1)), np.zeros(BLOCK)
            for r in rows_in:
                at = np.frombuffer(r["ids"], np.int32)
                sums[at] += np.frombuffer(r["mean"]).reshape(-1, DEPTH + 1)
                times[at] += 1
            at = np.flatnonzero(times)
            ids, mean = at.astype(np.int32).tobytes(), sums[at] / times[at][:, None]
        return pa.table({"block": pa.array([block], pa.int32()), "ids": pa.array([ids], pa.binary()), "mean": pa.array([mean.tobytes()], pa.binary())})

    sent = dealt.mapInArrow(run, "block int, part int, n long, ids binary, mean binary")
    for r in sent.groupBy("block").applyInArrow(merge, "block int, ids binary, mean binary").toLocalIterator():  # one network in blocks
        if r["block"] < 0:
            learner.set_dense(np.frombuffer(r["mean"]))
        else:
            at = r["block"] * BLOCK + np.frombuffer(r["ids"], np.int32)
            mean = np.frombuffer(r["mean"]).reshape(-1, DEPTH + 1)
            learner.net.embed[at], learner.embed[at] = mean[:, :DEPTH], mean[:, DEPTH]
    shared.unpersist()


class Model:
    """Network, language model and the logit that counts as 0.5 in each language ("" : all others)."""

    def __init__(self, net: Network | None, languages: langid.Model | None, shift: dict[str, float]):
        self.net, self.languages, self.shift = net, languages, shift

    def score(self, texts: list[str | None]) -> list[float]:
        if self.net is None:
            return [0.0] * len(texts)
        langs = [x[0] for x in self.languages.predict(texts)]
        z = [self.net.logit(rows_of(t)) - self.shift.get(lang, self.shift[""]) for t, lang in zip(texts, langs)]
        return [float(1 / (1 + np.exp(-np.clip(x, -30, 30)))) for x in z]


def thresholds(logits: DataFrame, scratch: Scratch) -> dict[str, float]:
    """For each value of `lang`, the logit with the best F1 over all its rows (lang, z, y): the middle of the widest gap between equally good ones.

    Running totals over the range-sorted distinct logits say how many rows and hits lie above each; a row a language reaches the driver.
    """
    each = logits.groupBy("lang", "z").agg((F.count("*") * (1 << 31) + F.sum("y")).alias("both"))  # rows above, hits below bit 31
    summed, parts = running(each, scratch, [F.col("lang"), F.col("z").desc()], "both", by=("lang",))
    totals = parts.groupBy("lang").agg(F.sum("part_sum").alias("total"))
    upto = F.col("before") + F.col("both")
    hits, n = upto.bitwiseAND(F.lit((1 << 31) - 1)), F.shiftright(upto, 31)
    rated = summed.join(F.broadcast(totals), "lang").withColumn("f1", 2 * hits / (n + F.col("total").bitwiseAND(F.lit((1 << 31) - 1))))
    # The next logit below is in the same part, or the first of a later one.
    tops = summed.groupBy("lang", "part").agg(F.max("z").alias("top"))
    later = tops.select("lang", "part", F.lead("top").over(Window.partitionBy("lang").orderBy("part")).alias("later"))
    inside = F.lead("z").over(Window.partitionBy("lang", "part").orderBy(F.col("z").desc()))
    rated = rated.withColumn("next", inside).join(later, ["lang", "part"]).withColumn("next", F.coalesce("next", "later"))
    best = scratch.cut(rated.groupBy("lang", "part").agg(F.max("f1").alias("m"))).groupBy("lang").agg(F.max("m").alias("m"))
    gap = F.coalesce(F.col("z") - F.col("next"), F.lit(1e-9))
    cut = F.coalesce((F.col("z") + F.col("next")) / 2, F.col("z") - 1)
    found = rated.join(F.broadcast(best), "lang").filter("f1 >= m - 1e-12").groupBy("lang").agg(F.max_by(cut, F.struct(gap, F.col("z"))).alias("cut"))
    return {r["lang"]: r["cut"] for r in found.collect()}


def fit(df: DataFrame, labels: DataFrame, allowed: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", label: str = "toxic") -> Model:
    """Learn from all labelled rows that `allowed` admits.

    A fifth of them, drawn by hash, is held back for the thresholds. Presence counts, epochs and thresholds
    run where the texts are; the driver holds one network. Without rows of both classes every score is 0.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    known = labels.filter(F.col(label).isin(0, 1) & allowed).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("y"))
    texts = df.filter(allowed).select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = scratch.cut(texts.join(known, "id").withColumn("back", F.pmod(F.xxhash64("id"), F.lit(5)) == 0))
    counts = {(r["back"], r["y"]): r["count"] for r in rows.groupBy("back", "y").count().collect()}  # four at most
    n = np.array([sum(c for (_, y), c in counts.items() if y == k) for k in (0, 1)])
    if not n.all():
        scratch.drop(rows)
        return Model(None, None, {"": 0.0})
    taught = held = rows
    if len(counts) == 4:
        taught, held = rows.filter("NOT back"), rows.filter("back")
        n = np.array([counts[False, k] for k in (0, 1)])
    learner = Learner(Network())
    learner.prime(presence(taught), n)
    weight = {k: float(min(n.sum() / (2 * n[k]), 10)) for k in (0, 1)}
    for turn in range(int(np.clip(-(-ENOUGH_STEPS // n.sum()), *EPOCHS))):
        pass_over(learner, taught, -(-int(n.sum()) // ROWS_A_PART), turn, weight)
    shared = spark.sparkContext.broadcast(learner.net)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = [shared.value.logit(rows_of(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("y"), pa.array(z, pa.float64())], names=["lang", "y", "z"])

    rated = scratch.cut(held.select("text", "lang", "y").mapInArrow(logits, "lang string, y int, z double"))
    several = rated.filter("lang IS NOT NULL").groupBy("lang").agg(F.sum("y").alias("hits"), F.sum(1 - F.col("y")).alias("rest")).filter("hits >= 10 AND rest >= 10").select("lang")
    own = rated.join(F.broadcast(several), "lang").select("lang", "y", "z")
    shift = thresholds(own.filter("lang <> ''").unionByName(rated.select(F.lit("").alias("lang"), "y", "z")), scratch)
    scratch.drop(rows, rated)
    return Model(learner.net, langid.fit(df, allowed, text=text, lang=lang, doc_id=doc_id), shift)


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add toxic_score (0 to 1, higher: likelier toxic) and toxic_pred (1 from 0.5 on) for every whole text.

    Null texts count as empty ones, which are scored like any other. Other columns pass; columns
    of the new names are replaced.
    """
    ship(df.sparkSession)
    df = df.drop("toxic_score", "toxic_pred")
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                s = shared.value.score(part.column(part.schema.get_field_index(text)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=[*part.schema.names, "toxic_score", "toxic_pred"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("toxic_score", T.DoubleType()), T.StructField("toxic_pred", T.IntegerType())]))
