"""Conversation structure repair: the cheapest edits that make a conversation an optional system turn and user-assistant pairs.

A turn and the run of insertions before it are one macro edit, written as a code: I for each insertion, then D, K or R. Every code
ends at its only letter that isn't I, so no code is another's beginning, and of two audits of as many turns the first in ASCII order
is settled by their first differing code. So a layer of the dynamic programme keeps, for each of the four states (nothing yet, after a system, a user
or an assistant turn), a cost, a rank among the states' audits, and a pointer to its parent, and no audit; the audit is rebuilt from
the pointers.

A conversation is cut into segments of at most SEGMENT turns. A segment's layers are run from each state it may begin in; the
costs and ranks at its end are chained over the segments, and then each segment is traced between the two states it got. So turns
of one very long conversation are worked on by many tasks. What passes through one task for a conversation, in order and without being held, is
a summary for each segment and, where the repaired text is hashed or written, its turns.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType

from .common import partitions_for, stored

#: Turns of a segment, by a shift of their numbers; bytes of input that a sorting task gets.
SHIFT, SORT_BYTES = 12, 64 << 20
#: States: nothing yet, after a system, a user, an assistant turn. Of each, the role that may be inserted or given next.
STATES, GIVEN = "-sua", {"-": "u", "s": "u", "u": "a", "a": "u"}
ROLES = {"u": "user", "a": "assistant"}
#: Faults, in order of precedence, and costs of edits.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"

Step = tuple[int, int, int, str]  #: state before, state after, cost, code
Layer = list[tuple[int, int] | None]  #: for each state (cost, rank), or None if it can't be reached


@functools.cache
def steps(kind: int) -> list[Step]:
    """The macro edits of a turn of this kind (initial among "sua" or other, times 4, plus fault), in order of their codes.

    More than two insertions before a turn lead to no state that fewer don't lead to.
    """
    initial, fault = "sua?"[kind // 4], kind % 4
    best: dict[tuple[str, str], tuple[int, str]] = {}
    for before in STATES:
        at = before
        for run in range(3):
            ways = [(at, DELETE, "D")]
            if fault in (FINE, TRUNCATED):
                extra = CUT if fault == TRUNCATED else 0
                ways.append((GIVEN[at], REROLE + extra, "R"))
                if initial == GIVEN[at] or (initial == "s" and at == "-"):
                    ways.append((initial, extra, "K"))
            for after, cost, letter in ways:
                way = (cost + INSERT * run, "I" * run + letter)
                best[before, after] = min(best.get((before, after), way), way)
            at = GIVEN[at]
    found = [(STATES.index(b), STATES.index(a), c, code) for (b, a), (c, code) in best.items()]
    return sorted(found, key=lambda s: (s[3], s[0], s[1]))


#: What ends a conversation: cost and insertions, by state; after nothing or an assistant none are needed.
ENDS = [(0, 0), (2 * INSERT, 2), (INSERT, 1), (0, 0)]


def advance(layer: Layer, ways: list[tuple[int, int, int, Any]]) -> tuple[Layer, list[tuple[int, Any] | None]]:
    """The next layer and, for each of its states, the parent (state before, code): least cost, ties to the least (rank, code)."""
    best: list[tuple[int, int, Any, int] | None] = [None] * 4
    for before, after, cost, code in ways:
        if (at := layer[before]) is not None:
            way = (at[0] + cost, at[1], code, before)
            if best[after] is None or way < best[after]:
                best[after] = way
    order = sorted((s for s in range(4) if best[s]), key=lambda s: best[s][1:3])
    out: Layer = [None] * 4
    for rank, s in enumerate(order):
        out[s] = (best[s][0], rank)
    return out, [b and (b[3], b[2]) for b in best]


def entry(state: int) -> Layer:
    return [(0, 0) if s == state else None for s in range(4)]


@functools.lru_cache(20_000)  # most conversations are short and have the same few sequences of kinds
def summary(kinds: bytes) -> list[int]:
    """From each state to each state, cost and rank; -1 where none leads."""
    out = []
    for state in range(4):
        layer = entry(state)
        for k in kinds:
            layer, _ = advance(layer, steps(k))
        out += [x for at in layer for x in (at or (-1, -1))]
    return out


@functools.lru_cache(20_000)
def trace(kinds: bytes, first: int, last: int) -> str:
    """The codes of the best way from state first to state last."""
    layer, parents = entry(first), []
    for k in kinds:
        layer, back = advance(layer, steps(k))
        parents.append(back)
    codes = []
    for back in reversed(parents):
        last, code = back[last]
        codes.append(code)
    return "".join(reversed(codes))


def summary_ways(flat: list[int]) -> list[tuple[int, int, int, int]]:
    """A segment's summary as ways from state to state, ranks in place of codes."""
    return [(b, a, flat[8 * b + 2 * a], flat[8 * b + 2 * a + 1]) for b in range(4) for a in range(4) if flat[8 * b + 2 * a] >= 0]


def _blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def _turns(convs: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    space = F.lit(" ")
    return convs.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"))


def _plan(turns: DataFrame) -> DataFrame:
    """(conv, first, kinds, codes) for each segment: kinds of its turns, a byte each, and their codes on the cheapest way.

    Turns are sorted over all tasks, by range, and numbered; a segment is what a conversation has of 4,096 numbers. What is written has no
    texts, only digests of them, by which repeated turns are told; a conversation's turns lie in as many range partitions as they need.
    """
    keys = ["conv", "turn", "role", "text", "_n"]
    parts = partitions_for(turns, SORT_BYTES)
    ordered = turns.withColumn("_n", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ends_well = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1).isin(".", "!", "?")
    narrow = ordered.select(
        "conv", F.monotonically_increasing_id().alias("seq"), "role", F.unhex(F.sha2("text", 256)).alias("said"),
        (F.instr(F.lit("sua"), F.substring("role", 1, 1)) - 1).alias("at"), _blank(F.col("text")).alias("blank"), (~ends_well).alias("cut"), (F.substring("role", 1, 1) == "").alias("none"),
    )
    narrow = stored(narrow, "turns")
    firsts = narrow.groupBy("conv", "role", "said").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("new"))
    initial = F.when(F.col("none") | (F.col("at") < 0), 3).otherwise(F.col("at"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("new").isNull(), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(FINE)
    told = narrow.join(firsts, "seq", "left").select("conv", "seq", (4 * initial + fault).alias("kind"))
    packed = told.groupBy("conv", F.shiftright("seq", SHIFT).alias("seg")).agg(F.min("seq").alias("first"), F.sort_array(F.collect_list(F.struct("seq", "kind"))).alias("turns"))
    segments = stored(packed.select("conv", "first", F.transform("turns", lambda t: t["kind"]).alias("kinds")), "segments")

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [summary(bytes(k)) for k in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int64()))], names=["conv", "first", "ways"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments by conversation and order: the states that each begins and ends in. Four bytes or so are held for a segment."""
        firsts: list[int] = []
        parents: list[list[tuple[int, Any] | None]] = []
        out: list[tuple[int, int, int]] = []
        layer, now = entry(0), object()

        def ended() -> None:
            if not firsts:
                return
            last = min((s for s in range(4) if layer[s]), key=lambda s: (layer[s][0] + ENDS[s][0], layer[s][1]))
            for first, back in zip(reversed(firsts), reversed(parents)):
                before = back[last][0]
                out.append((first, before, last))
                last = before
            firsts.clear()
            parents.clear()

        def handed() -> pa.RecordBatch:
            columns = zip(*out) if out else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32()))], names=["first", "begin", "end"])

        for b in batches:
            for conv, first, flat in zip(*(c.to_pylist() for c in b.columns)):
                if conv != now or not firsts:
                    ended()
                    layer, now = entry(0), conv
                layer, back = advance(layer, summary_ways(flat))
                firsts.append(first)
                parents.append(back)
            yield handed()
            out.clear()
        ended()
        yield handed()

    ways = segments.mapInArrow(summaries, segments.select("conv", "first").schema.add("ways", ArrayType(LongType())))
    states = ways.repartition("conv").sortWithinPartitions("conv", "first").mapInArrow(chain, "first long, begin int, end int")

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            conv, first, kinds, begin, end = b.columns
            kinds = [bytes(k) for k in kinds.to_pylist()]
            codes = [trace(k, i, j) for k, i, j in zip(kinds, begin.to_pylist(), end.to_pylist())]
            yield pa.RecordBatch.from_arrays([conv, first, pa.array(kinds, pa.binary()), pa.array(codes, pa.string())], names=["conv", "first", "kinds", "codes"])

    return segments.join(states, "first").select("conv", "first", "kinds", "begin", "end").mapInArrow(traced, segments.select("conv", "first").schema.add("kinds", "binary").add("codes", "string"))


def _batch(rows: list[tuple[Any, ...]], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


class Repair:
    """One conversation's edits, to be applied to its turns in order."""

    def __init__(self, conv: Any) -> None:
        self.conv, self._codes, self._kinds = conv, [], []
        self.low: int | None = None
        self.high: int | None = None
        self.turns = 0
        self.last: int | None = None
        self._text: str | None = None
        self.state, self.at, self.tail = "-", 0, ""

    def plan(self, kinds: bytes, codes: str) -> None:
        self._kinds.append(kinds)
        self._codes.append(codes)

    @property
    def codes(self) -> str:
        """All codes, without the insertions at the end."""
        if self._text is None:
            self._text = "".join(self._codes)
            self._codes.clear()
        return self._text

    def saw(self, turn: int | None) -> None:
        """Turns come in order, nulls first."""
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.last
            self.high = self.last = turn

    def edits(self, role: str) -> Iterator[tuple[str, str | None]]:
        """(edit, role after it) of the insertions before the next turn and of the turn; a deleted turn has no role."""
        while True:
            edit = self.codes[self.at]
            self.at += 1
            if edit == "D":
                yield edit, None
                return
            self.state = role[:1] if edit == "K" else GIVEN[self.state]
            yield edit, role if edit == "K" else ROLES[self.state]
            if edit != "I":
                return

    def closing(self) -> list[str]:
        """Roles of the insertions at the end."""
        out = []
        for _ in range(ENDS[STATES.index(self.state)][1]):
            self.state = GIVEN[self.state]
            out.append(ROLES[self.state])
        self.tail = "I" * len(out)
        return out

    def report(self) -> tuple[int, int, int, int, int, int, str]:
        """gaps, blank, duplicate, truncated, illegal, cost, audit; after closing()."""
        kinds = b"".join(self._kinds)
        faults = [sum(kinds.count(4 * i + f) for i in range(4)) for f in (BLANK, DUPLICATE, TRUNCATED)]
        initials = bytes(k // 4 for k in kinds)
        fair = sum(initials[i : i + 2] in (b"\0\1", b"\1\2", b"\2\1") for i in range(len(initials) - 1))
        audit = self.codes + self.tail
        price = {"D": DELETE, "R": REROLE, "I": INSERT}
        kept_cut = sum(k % 4 == TRUNCATED and c != "D" for k, c in zip(kinds, audit.replace("I", "")))
        cost = sum(audit.count(e) * p for e, p in price.items()) + CUT * kept_cut
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, *faults, max(len(kinds) - 1, 0) - fair, cost, audit


def _applied(convs: DataFrame, turns: DataFrame, emit: Callable[[Iterator[tuple[str, Any, Any]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """emit() over the events of whole conversations, in order: ("start", Repair, None), ("turn", Repair, (turn, role, text)), ("end", Repair, None).

    A conversation's codes come before its turns, in the same sort, so texts are shuffled once here and are never held.
    """
    none = lambda kind: F.lit(None).cast(kind)
    all_convs = convs.select("conv").distinct().select("conv", F.lit(0).alias("part"), none("long").alias("first"), none("binary").alias("kinds"), none("string").alias("codes"), none(turns.schema["turn"].dataType.simpleString()).alias("turn"), none("string").alias("role"), none("string").alias("text"))
    plan = _plan(turns).select("conv", F.lit(1), "first", "kinds", "codes", none(turns.schema["turn"].dataType.simpleString()), none("string"), none("string"))
    rows = turns.select("conv", F.lit(2), none("long"), none("binary"), none("string"), "turn", "role", "text")
    dealt = all_convs.union(plan).union(rows).repartition("conv").sortWithinPartitions("conv", "part", "first", "turn", "role", "text")

    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Any, Any]]:
        repair: Repair | None = None
        for whole in batches:
            for b in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                for conv, part, _, kinds, codes, turn, role, text in zip(*(c.to_pylist() for c in b.columns)):
                    if part == 0:
                        if repair is not None:
                            yield "end", repair, None
                        repair = Repair(conv)
                        yield "start", repair, None
                    elif part == 1:
                        repair.plan(kinds, codes)
                    else:
                        repair.saw(turn)
                        yield "turn", repair, (turn, role, text)
        if repair is not None:
            yield "end", repair, None

    return dealt.mapInArrow(lambda batches: emit(events(batches)), schema)


def repair_report(convs: DataFrame, turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for every conversation of convs, with what is wrong in its turns and how it is repaired.

    conv, gaps (whole numbers that turns leave out), blank, duplicate, truncated (turns by their first fault), illegal (neighbours whose initials
    aren't su, ua or au), cost and audit (the cheapest edits, ties to the first in ASCII order), repaired_sha256 (of the repaired role:text lines).
    Turns go by number, nulls first, then by role and text, so repeated rows and ties have one order. A null role or text is one space; a null
    conversation is one like any other. A conversation without turns: zeros, no edits, the hash of nothing.
    """
    turns, kind = _turns(turns, conv, turn, role, text), convs.schema[conv].dataType
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    types, columns = [to_arrow_type(kind), *[pa.int64()] * 6, pa.string(), pa.string()], [conv, *names, "audit", "repaired_sha256"]

    def emit(events: Iterator[tuple[str, Any, Any]]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[Any, ...]] = []
        sha, lines = hashlib.sha256(), 0

        def line(role: str, text: str) -> None:
            nonlocal lines
            sha.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
            lines += 1

        for what, repair, row in events:
            if what == "start":
                sha, lines = hashlib.sha256(), 0
            elif what == "turn":
                for edit, after in repair.edits(row[1]):
                    if after is not None:
                        line(after, "" if edit == "I" else row[2])
            else:
                for after in repair.closing():
                    line(after, "")
                out.append((repair.conv, *repair.report(), sha.hexdigest()))
                if len(out) >= 500:
                    yield _batch(out, types, columns)
                    out.clear()
        yield _batch(out, types, columns)

    schema = f"`{conv}` {kind.simpleString()}, {', '.join(f'{n} long' for n in names)}, audit string, repaired_sha256 string"
    return _applied(convs.select(F.col(conv).alias("conv")), turns, emit, schema)


def repaired_turns(convs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations: conv, position (from 0), edit (K, R or I), turn (null for an inserted one), role, text.

    Order, nulls and ties as in repair_report(); deleted turns have no row.
    """
    rows, kind, number = _turns(convs, conv, turn, role, text), convs.schema[conv].dataType, convs.schema[turn].dataType
    types, columns = [to_arrow_type(kind), pa.int64(), pa.string(), to_arrow_type(number), pa.string(), pa.string()], [conv, "position", "edit", turn, role, text]

    def emit(events: Iterator[tuple[str, Any, Any]]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[Any, ...]] = []
        position = 0

        for what, repair, row in events:
            if what == "start":
                position = 0
            elif what == "turn":
                for edit, after in repair.edits(row[1]):
                    if after is not None:
                        out.append((repair.conv, position, edit, None if edit == "I" else row[0], after, "" if edit == "I" else row[2]))
                        position += 1
            else:
                for after in repair.closing():
                    out.append((repair.conv, position, "I", None, after, ""))
                    position += 1
            if len(out) >= 500:
                yield _batch(out, types, columns)
                out.clear()
        yield _batch(out, types, columns)

    schema = f"`{conv}` {kind.simpleString()}, position long, edit string, `{turn}` {number.simpleString()}, `{role}` string, `{text}` string"
    return _applied(convs.select(F.col(conv).alias("conv")), rows, emit, schema)
