"""Conversation structure repair at least cost, over one automaton of all conversations' shapes.

What a repair has to know of a row is one letter: its role and its fault. The letters of a conversation
are its signature, and a repaired conversation is one system turn at most, then user and assistant by turns. Signatures
are minimised from the end: those that end alike share the nodes of an acyclic word graph, in which a node stands for the
rest of a conversation. Signatures are sorted from their last letter on, dealt to ranges of that order, and
the nodes of a range are built along one path, of which the next signature keeps what it
shares. The cost-to-go and the first letter of the best audit are computed once for every
node and state of the grammar; all conversations of one shape read the result.

Edits of one place differ in their first letter, so the least of equally cheap audits is known from
that letter alone, and a node costs the same however long the rest is.

Rows are ordered by a range sort, so the numbers they get and what is counted from them need no window over
a conversation, and a long conversation is spread over many tasks. Only the joined text of a
conversation is made in one place: its rows stream through, nothing is held.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.llm.running import PER_PARTITION
from pagelode.llm.shared import Scratch, partitions_for, ship

VISIBLE = r"[^\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Grammar states: nothing yet, after system, after user, after assistant. What a turn of a role leads to (-1: nowhere),
#: and the only role that may be inserted or assigned in a state.
NEXT = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}
FILL = "uuau"
ROLE = {"u": "user", "a": "assistant"}
STATES = range(4)


def damage(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) with a fault in one row of four, chosen by a checksum of its place.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 takes out its sentence ends, 3 repeats it, 4
    makes its role user. Null parts read as one space; `conv` is the id as text, so that a null id is one like any other.
    """
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(as_text(conv_id), F.lit(":"), as_text(turn)).cast("binary")) % 20
    told = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(as_text(text), "[.!?]", "")).otherwise(as_text(text))
    rows = df.filter(fault != 0).select(conversation(conv_id), F.col(turn).alias("turn"), F.when(fault == 4, "user").otherwise(as_text(role)).alias("role"), told.alias("text"), F.when(fault == 3, 2).otherwise(1).alias("n"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n", "copy")


def conversation(conv_id: str = "conv_id"):
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit("")).alias("conv")


def ordered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows with `at`, a number that rises with (conv, turn, role, text), nulls first, and `part`, the range they are in."""
    n = partitions_for(rows.count(), PER_PARTITION, rows.sparkSession)
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "text")]
    return scratch.cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()))


def faults(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, turn, at, part, initial, fault): a row's first fault of blank, duplicate, truncated; else empty.

    Rows with equal role and text are found by a digest and the place of the first of them, so that text that
    recurs in one conversation is combined before it is shuffled.
    """
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1)
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    marks = rows.select("conv", "turn", "at", "part", digest.alias("digest"), initial.alias("initial"), (~F.col("text").rlike(VISIBLE)).alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    first = scratch.cut(marks.groupBy("conv", "digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    fault = F.when(F.col("blank"), "blank").when(F.col("at") > F.col("first"), "duplicate").when(F.col("cut"), "truncated").otherwise("")
    return marks.join(first, ["conv", "digest"], "left").select("conv", "turn", "at", "part", "initial", fault.alias("fault"))


def signatures(marked: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, initials, signature).

    A letter of the signature is the row's role initial, upper case if it is truncated, x if the row must go.
    Letters are joined by range first, so a long conversation is put together from a few strings.
    """
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    kinds = ("blank", "duplicate", "truncated")
    joined = lambda c: F.array_join(F.transform(F.col("row"), lambda x: x[c]), "").alias(c)
    counted = [F.count(F.when(F.col("fault") == k, 1)).alias(k) for k in kinds]
    chunks = marked.groupBy("conv", "part").agg(F.sort_array(F.collect_list(F.struct("at", "initial", letter.alias("letter")))).alias("row"), *counted)
    chunks = chunks.select("conv", "part", joined("initial"), joined("letter"), *kinds)
    whole = chunks.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "initial", "letter"))).alias("row"), *(F.sum(k).alias(k) for k in kinds))
    whole = whole.select("conv", joined("initial"), joined("letter"), *kinds).withColumnsRenamed({"initial": "initials", "letter": "signature"})
    turns = marked.select("conv", "turn").distinct().groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    return whole.join(turns, "conv")


class WordGraph:
    """Nodes along one signature, from its end: cost-to-go and first letter of the best audit in each grammar state."""

    def __init__(self):
        self.signature, self.cost, self.letter = "", array("q"), bytearray()
        #: Without rows left: an empty conversation is fine, an assistant may end one.
        self._node([0, None, None, 0], [{"": 0}, {}, {}, {"": 0}])

    def _node(self, least: list, options: list[dict[str, int]]) -> None:
        best = [1 << 60 if c is None else c for c in least]
        for _ in STATES:
            best = [min(best[q], INSERT + best[NEXT[FILL[q]][q]]) for q in STATES]
        for q in STATES:
            options[q]["I"] = INSERT + best[NEXT[FILL[q]][q]]
            self.letter += min(k for k, c in options[q].items() if c == best[q]).encode() or b"\0"
        self.cost.extend(best)

    def push(self, symbol: str) -> None:
        """One more row in front."""
        rest, role, add = self.cost[-4:], symbol.lower(), TRUNCATED if symbol.isupper() else 0
        options = []
        for q in STATES:
            o = {"D": DELETE + rest[q]}
            if role != "x":
                o["R"] = REROLE + add + rest[NEXT[FILL[q]][q]]
                if role in NEXT and NEXT[role][q] >= 0:
                    o["K"] = add + rest[NEXT[role][q]]
            options.append(o)
        self._node([min(o.values()) for o in options], options)

    def solve(self, signature: str) -> tuple[int, str]:
        """Cost and audit. Nodes that the last signature has in common from the end are kept."""
        backward, same = signature[::-1], 0
        for x, y in zip(backward, self.signature):
            if x != y:
                break
            same += 1
        del self.cost[4 * (same + 1) :], self.letter[4 * (same + 1) :]
        for symbol in backward[same:]:
            self.push(symbol)
        self.signature = backward
        audit, q, at = [], 0, len(signature)
        while letter := self.letter[4 * at + q]:
            audit.append(chr(letter))
            role = FILL[q] if letter != ord("K") else signature[len(signature) - at].lower()
            q = q if letter == ord("D") else NEXT[role][q]
            at -= letter != ord("I")
        return self.cost[-4], "".join(audit)


def audits(signature: DataFrame, scratch: Scratch) -> DataFrame:
    """(signature, cost, audit) for every distinct signature, sorted from the end so that shared nodes meet in one task."""
    ship(signature.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = WordGraph()
        for b in batches:
            found = [graph.solve(x.as_py()) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=["signature", "cost", "audit"])

    distinct = scratch.cut(signature.select("signature").distinct())
    n = partitions_for(distinct.count(), PER_PARTITION, signature.sparkSession)
    return scratch.cut(distinct.repartitionByRange(n, F.reverse("signature")).sortWithinPartitions(F.reverse("signature")).mapInArrow(run, "signature string, cost long, audit string"))


def edited(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, turn, role, text, edit) of repaired turns from rows (conv, at, turn, role, text) in order, each conversation's audit before them.

    Before a conversation's turns comes one row with edit null. Deleted rows are left out, inserted ones have no turn.
    """
    conv, audit, k, q = None, "", 0, 0

    def inserts() -> Iterator[tuple]:
        nonlocal k, q
        while k < len(audit) and audit[k] == "I":
            role = FILL[q]
            k, q = k + 1, NEXT[role][q]
            yield conv, None, ROLE[role], "", "I"

    for c, at, turn, role, text in rows:
        if at < 0:
            yield from inserts()
            conv, audit, k, q = c, text, 0, 0
            yield conv, None, None, None, None
            continue
        yield from inserts()
        edit, k = audit[k], k + 1
        if edit == "D":
            continue
        to = FILL[q] if edit == "R" else role[0]
        q = NEXT[to][q]
        yield conv, turn, ROLE[to] if edit == "R" else role, text, edit
    yield from inserts()


class Repair:
    """Faults and cheapest repairs of all conversations of a table (conv, turn, role, text), as `damage` gives it.

    summary: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, one row a conversation.
    turns(): the repaired turns. digests(): SHA-256 of a conversation's turns as `role:text` lines.
    Rows with equal turns are taken in the order of role and text; rows that are equal in all count as repeats. Roles other than
    system, user and assistant, empty ones too, can only be changed or deleted. An empty table gives empty results.
    """

    def __init__(self, rows: DataFrame, scratch: Scratch):
        self.scratch, self.rows = scratch, ordered(rows, scratch)
        found = scratch.cut(signatures(faults(self.rows, scratch)))
        legal = F.regexp_count("initials", F.lit("(?=su|ua|au)."))
        illegal = F.greatest(F.length("initials") - 1 - legal, F.lit(0)).cast("long")
        solved = found.join(audits(found, scratch), "signature")
        self.summary = scratch.cut(solved.select("conv", "gaps", "blank", "duplicate", "truncated", illegal.alias("illegal"), "cost", "audit"))

    def _stream(self, made, schema: str) -> DataFrame:
        """Run `made` over each conversation's audit and rows, in order."""
        ship(self.rows.sparkSession)
        none = F.lit(None).cast("string")
        heads = self.summary.select("conv", F.lit(-1).cast("long").alias("at"), F.lit(None).cast(self.rows.schema["turn"].dataType).alias("turn"), none.alias("role"), F.col("audit").alias("text"))
        both = heads.unionByName(self.rows.select("conv", "at", "turn", "role", "text"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (tuple(v.as_py() for v in r) for b in batches for r in zip(*b.columns))
            return made(edited(rows))

        n = partitions_for(self.rows.count(), PER_PARTITION, self.rows.sparkSession)
        return both.repartition(n, "conv").sortWithinPartitions("conv", "at").mapInArrow(run, schema)

    def turns(self) -> DataFrame:
        """(conv, seq, turn, role, text, edit): repaired turns, numbered from 0; K kept, R role changed, I inserted."""

        def made(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            out, seq = [], 0
            for conv, turn, role, text, edit in rows:
                if edit is None:
                    seq = 0
                    continue
                out.append((conv, seq, turn, role, text, edit))
                seq += 1
                if len(out) == 1000:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)

        schema = pa.schema([("conv", pa.string()), ("seq", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
        return self._stream(made, "conv string, seq long, turn long, role string, text string, edit string")

    def digests(self) -> DataFrame:
        """(conv, repaired_sha256)."""

        def made(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            conv, sha, between = None, None, b""
            out: list[tuple[str, str]] = []
            for c, _, role, text, edit in rows:
                if edit is None:
                    if sha:
                        out.append((conv, sha.hexdigest()))
                    conv, sha, between = c, hashlib.sha256(), b""
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["conv", "repaired_sha256"])
                        out = []
                    continue
                sha.update(between + f"{role}:{text}".encode())
                between = b"\n"
            if sha:
                out.append((conv, sha.hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["conv", "repaired_sha256"])

        return self._stream(made, "conv string, repaired_sha256 string")


def repair(df: DataFrame, scratch: Scratch, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for every conv_id of `df`: what is wrong after `damage`, the cheapest repair and the digest of its result.

    A conversation that lost all its rows has zeros, an empty audit and the digest of nothing. A null
    conv_id is a conversation like any other. Columns that are not named are not read.
    """
    done = Repair(damage(df, conv_id, turn, role, text).withColumn("turn", F.col("turn").cast("long")), scratch)
    all_ids = df.select(conversation(conv_id), F.col(conv_id).alias("conv_id")).groupBy("conv").agg(F.first("conv_id").alias("conv_id"))
    out = all_ids.join(done.summary, "conv", "left").join(done.digests(), "conv", "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256().hexdigest()
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
