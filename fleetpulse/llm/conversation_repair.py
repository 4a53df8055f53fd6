"""Conversation structure repair: the cheapest edits that give every conversation a legal order of roles.

One conversation's messages, in order, are the layers of a DAG whose nodes are the states of the legal role orders
``(s?(ua)+)?``.  An edge inserts up to two empty messages and then keeps, reroles or deletes the next message.  Its
weight is one integer: the cost in the high digits, the letters of its edits (D, I, K, R) in low digits at the place of
the message.  A message has a field of three digits, for II and one more letter; fields are padded with zeros at the
end, and as each ends with the only letter that isn't I, comparing padded fields is comparing the audits themselves.
The least integer that reaches a legal end state is therefore the cheapest repair and, of these, the one with the least
audit: nothing else breaks ties.

Messages stream through a task in order, so a conversation is never held.  After BLOCK messages the low digits of the
states' integers are decoded, handed to a chain of audit pieces and replaced by their rank among the states, which
keeps every later comparison; integers stay short however long a conversation is.  Each state carries the running hash
of its own repaired text, so the text isn't held either.  The hash is sequential by its definition: one conversation is
read by one task, in bounded memory but for its audit (one byte for each edit).

Defined results: a null role or text is one space; a null conversation id is a conversation of its own; rows come by
turn, nulls first, then by role, text and repeat, so ties don't depend on the input's order; repeated rows are
duplicates; any number of rows and any length of text goes; an empty table gives no rows; columns other than conv_id,
turn, role and text don't matter, whatever their names.  A role that is empty has no initial and can't be kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Costs of the edits; STUMP is added for a truncated message that stays.
REROLE, DELETE, INSERT, STUMP = 3, 4, 3, 3

#: States: nothing yet, after the system message, after a user's, after an assistant's.  ENDS may be the last one.
STATES, ENDS = range(4), (0, 3)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
ROLE = {"u": "user", "a": "assistant"}

#: Digits of the letters, in ASCII order (0 is the padding), digits of a field, messages until states are ranked anew.
DIGIT, BITS, FIELD, BLOCK = {"D": 1, "I": 2, "K": 3, "R": 4}, 3, 3, 64
LETTER = {v: k for k, v in DIGIT.items()}

#: What a row is when it reaches the repair.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)

REPORT = """conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint,
            audit string, repaired_sha256 string"""


def _word(letters: str) -> int:
    """The field of up to FIELD letters, padded with zeros at its end."""
    out = 0
    for at in range(FIELD):
        out = out << BITS | (DIGIT[letters[at]] if at < len(letters) else 0)
    return out


def _inserts(state: int) -> Iterator[tuple[int, str]]:
    """States that up to two inserted messages reach, with the roles inserted."""
    roles = ""
    while True:
        yield state, roles
        if len(roles) == 2:
            return
        role = "a" if state == 2 else "u"
        state, roles = STEP[state, role], roles + role


def _edges(kind: int, initial: str) -> list[tuple[int, int, int, int, str, str]]:
    """(from, to, cost, field, roles inserted, role of the message or "") of all edits of one message; K stands for its own role."""
    best: dict[tuple[int, int], tuple] = {}
    for start in STATES:
        for state, roles in _inserts(start):
            ways = [("D", state, DELETE, "")]
            if kind in (SOUND, TRUNCATED):
                more = STUMP * (kind == TRUNCATED)
                if (state, initial) in STEP:
                    ways.append(("K", STEP[state, initial], more, "K"))
                role = "a" if state == 2 else "u"
                ways.append(("R", STEP[state, role], REROLE + more, role))
            for letter, to, cost, out in ways:
                edge = (cost + INSERT * len(roles), _word("I" * len(roles) + letter), roles, out)
                best[start, to] = min(best.get((start, to), edge), edge)
    return [(a, b, *edge) for (a, b), edge in best.items()]


#: All edges by kind of row and initial ("" for any other initial, which can't be kept).
EDGES = {(kind, i): _edges(kind, i) for kind in range(4) for i in ("s", "u", "a", "")}


class Repair:
    """The dynamic program over the messages of one conversation, one at a time."""

    def __init__(self) -> None:
        self.best: dict[int, int] = {0: 0}  # state: cost and audit as one integer
        self.hashes = {0: hashlib.sha256()}
        self.pieces: dict[int, tuple | None] = {0: None}  # state: chain of decoded fields
        self.rows = 0

    def add(self, kind: int, role: str, text: str) -> None:
        """The next message.  Integers grow by one field: cost, rank, then the fields of this block."""
        width = BITS * FIELD
        found: dict[int, tuple[int, int, str, str]] = {}
        for a, b, cost, field, roles, out in EDGES[kind, role[:1] if role[:1] in ("s", "u", "a") else ""]:
            if a in self.best:
                # the cost's unit stands above the widest block, so that it never meets the letters
                value = self.best[a] + (cost << UNIT) + (field << (BLOCK - 1 - self.rows) * width)
                if b not in found or value < found[b][0]:
                    found[b] = (value, a, roles, out)
        hashes = {}
        for b, (_, a, roles, out) in found.items():
            parts = [f"{ROLE[r]}:" for r in roles]
            if out:
                parts.append(f"{role if out == 'K' else ROLE[out]}:{text}")
            hashes[b] = self._fed(a, parts)
        self.pieces = {b: self.pieces[a] for b, (_, a, _, _) in found.items()}
        self.best, self.hashes = {b: v[0] for b, v in found.items()}, hashes
        self.rows += 1
        if self.rows == BLOCK:
            self._rank()

    def _fed(self, state: int, parts: list[str]) -> hashlib._Hash:
        if not parts:
            return self.hashes[state]
        out = self.hashes[state].copy()
        out.update((("\n" if state else "") + "\n".join(parts)).encode("utf-8", "surrogatepass"))
        return out

    def _rank(self) -> None:
        """Letters so far go to the chain; what stays of them is their rank among the states."""
        low = {s: v & ((1 << UNIT) - 1) for s, v in self.best.items()}
        ranks = {v: i for i, v in enumerate(sorted(set(low.values())))}
        fields = (1 << BITS * FIELD * BLOCK) - 1
        self.pieces = {s: (self.pieces[s], _decoded(v & fields)) for s, v in low.items()}
        self.best = {s: (v >> UNIT) << UNIT | ranks[low[s]] << BITS * FIELD * BLOCK for s, v in self.best.items()}
        self.rows = 0

    def end(self) -> tuple[int, str, str]:
        """(cost, audit, hash of the repaired text) of the least integer, last inserts included."""
        width = BITS * FIELD
        ways = []
        for a, value in self.best.items():
            for state, roles in _inserts(a):
                if state in ENDS:
                    ways.append((value + (INSERT * len(roles) << UNIT) + (_word("I" * len(roles)) << (BLOCK - 1 - self.rows) * width), a, roles))
        value, a, roles = min(ways)
        audit, at = [_decoded(value & ((1 << width * BLOCK) - 1))], self.pieces[a]
        while at:
            at, piece = at
            audit.append(piece)
        return value >> UNIT, "".join(reversed(audit)), self._fed(a, [f"{ROLE[r]}:" for r in roles]).hexdigest()


#: Bits below the cost: a block of fields and two bits of rank.
UNIT = BITS * FIELD * BLOCK + 2


def _decoded(fields: int) -> str:
    return "".join(LETTER[d] for at in range(FIELD * BLOCK - 1, -1, -1) if (d := fields >> at * BITS & 7))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with one of five faults by the crc32 of ``conv_id:turn``; ``gone`` rows stay to name their conversation."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    by = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("fault"))
    return by.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("fault") == 0).alias("gone"), F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def _kind(first: Column) -> Column:
    inked = r"[^\x20\x09-\x0D]"
    return (F.when(~F.col("text").rlike(inked), BLANK).when(~first, DUPLICATE)
            .when(~F.regexp_extract("text", rf"({inked})[\x20\x09-\x0D]*\z", 1).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND))


def faults(rows: DataFrame) -> DataFrame:
    """Every message with its first fault as ``kind``, all of a conversation in one partition, in order.

    One shuffle, by conversation: the window over equal messages needs no other, and both sorts spill.
    """
    if "gone" not in rows.columns:
        text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
        rows = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), F.lit(False).alias("gone"), F.lit(0).alias("copy"))
    order = [F.col("turn").asc_nulls_first(), "role", "text", "copy"]
    same = Window.partitionBy("conv_id", "gone", "role", F.sha2("text", 256)).orderBy(*order)
    first = F.row_number().over(same) == 1
    out = rows.repartition("conv_id").withColumn("first", first).select("conv_id", "turn", "role", "text", "gone", "copy", _kind(F.col("first")).cast("int").alias("kind"))
    return out.sortWithinPartitions("conv_id", *order).drop("copy")


class _Report:
    """Counts of one conversation beside its repair."""

    def __init__(self) -> None:
        self.counts, self.turns, self.low, self.high, self.illegal, self.before, self.repair = [0] * 4, 0, None, None, 0, None, Repair()

    def add(self, turn: int | None, role: str, text: str, kind: int) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.counts[kind] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        self.repair.add(kind, role, text)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, *self.counts[1:], self.illegal, *self.repair.end())


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "kind")))

    types = [pa.int64()] * 7 + [pa.string()] * 2
    names = re.findall(r"(\w+) (?:bigint|string)", REPORT)
    done: list[tuple] = []
    for conv, members in groupby(rows(), key=lambda r: r[0]):
        report = _Report()
        for _, turn, role, text, gone, kind in members:
            if not gone:
                report.add(turn, role, text, kind)
        done.append((conv, *report.row()))
        if len(done) == 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)
            done = []
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row for each conversation: its faults, the cost and audit of its cheapest repair, the repaired text's hash."""
    return faults(rows).mapInArrow(_repaired, REPORT)


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follows each audit along its conversation's messages."""
    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "audit")))

    out: list[tuple] = []

    def flushed() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string()))]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", "position", "role", "text"])

    for conv, members in groupby(rows(), key=lambda r: r[0]):
        state, at, position, audit = 0, 0, 0, ""
        for _, role, text, audit in members:
            while at < len(audit):
                letter = audit[at]
                at += 1
                if letter != "D":
                    need = "a" if state == 2 else "u"
                    message = (role, text) if letter == "K" else (ROLE[need], text if letter == "R" else "")
                    state = STEP[state, role[:1] if letter == "K" else need]
                    out.append((conv, position, *message))
                    position += 1
                if letter != "I":
                    break
            if len(out) >= 1000:
                yield flushed()
        for _ in audit[at:]:
            need = "a" if state == 2 else "u"
            state = STEP[state, need]
            out.append((conv, position, ROLE[need], ""))
            position += 1
    if out:
        yield flushed()


def repaired_messages(rows: DataFrame, report: DataFrame) -> DataFrame:
    """(conv_id, position, role, text) of the repaired conversations, by the audits of ``repair_conversations``."""
    audits = report.select(F.col("conv_id").alias("_conv"), "audit")
    kept = faults(rows).filter(~F.col("gone")).join(audits, F.col("conv_id").eqNullSafe(F.col("_conv")))
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    return (kept.select("conv_id", "turn", "role", "text", "audit").repartition("conv_id").sortWithinPartitions("conv_id", *order)
            .mapInArrow(_messages, "conv_id bigint, position bigint, role string, text string"))
