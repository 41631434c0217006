"""Repair of conversations: the cheapest edits of the turns after which roles follow ``(s?(ua)+)?``.

Turns are kept (K), given another role (R) or deleted (D), and empty turns inserted (I). What decides between edits is
one integer: its high digits are the cost, then come the letters of the edits so far, in places of fixed width from
the left, with zeros after the last. Among integers the least is the cheapest, and of those the least as text. So a
shortest path over (turn, last role) by plain integer minimum decides everything. An insertion belongs to the next turn
that stays, so two paths to one node have as many letters of turns, end with one, and neither goes on from the other.

Places are limited to CHUNK turns: then the letters are put aside and a number takes their place, the rank among the
texts so far. By the same ranks the parts of a conversation that lies in several tasks are put together: each task
solves its part from every role that may come before.

A row of a repair stream is a turn that stays (``place`` from 1 on, role, text), or, before the turns of each part, the
letters of its edits (``place`` 0, in ``text``), with the totals of the conversation in its first part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .text import SPACES

LETTERS = " DIKR"  # the digits 1 to 4; ascending, as their characters are
KEEP_COST, ROLE_COST, DELETE_COST, INSERT_COST, CUT_COST = 0, 2, 3, 2, 1
CHUNK = 64
BITS = 3
WIDTH = 2 * CHUNK
RANK_AT, COST_AT = BITS * WIDTH, BITS * WIDTH + 3
# What came last: nothing, a system turn, a user's, an assistant's.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
BY_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
AT_END = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
FINE, BLANK, DUPLICATE, CUT = range(4)
LEGAL = {"su", "ua", "au"}
TOTALS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
ROWS_AT_ONCE = 4096


def _moves(initial: int | None, fault: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each last role: the role after the turn, the cost, the number of letters and their digits."""
    out = {}
    for last in range(4):
        ways = [(last, DELETE_COST, "D")]
        extra = CUT_COST if fault == CUT else 0
        if fault in (FINE, CUT):
            for before, cost, edits in ((last, 0, ""), (NEXT[last], INSERT_COST, "I")):
                now = NEXT[before]
                if initial == now:
                    ways.append((now, cost + extra + KEEP_COST, edits + "K"))
                else:
                    ways.append((now, cost + extra + ROLE_COST, edits + "R"))
            if initial == SYSTEM and last == NOTHING:
                ways.append((SYSTEM, extra + KEEP_COST, "K"))
        packed = []
        for to, cost, edits in ways:
            digits = 0
            for letter in edits:
                digits = digits << BITS | LETTERS.index(letter)
            packed.append((to, cost << COST_AT, len(edits), digits))
        out[last] = packed
    return out


MOVES = {(i, f): _moves(i, f) for i in (None, SYSTEM, USER, ASSISTANT) for f in (FINE, BLANK, DUPLICATE, CUT)}


class Paths:
    """Least weights from some last roles on, turn by turn."""

    def __init__(self, starts: tuple[int, ...]):
        # By start, then last role: weight, letters in it, and the last role at the begin of the chunk.
        self.now = {s: {s: (0, 0, s)} for s in starts}
        self.done: dict[int, list[dict[int, tuple[int, str]]]] = {s: [] for s in starts}
        self.turns = 0

    def add(self, initial: int | None, fault: int) -> None:
        if self.turns == CHUNK:
            self._put_aside()
        self.turns += 1
        moves = MOVES[initial, fault]
        for start, nodes in self.now.items():
            after: dict[int, tuple[int, int, int]] = {}
            for last, (weight, n, origin) in nodes.items():
                for to, cost, more, digits in moves[last]:
                    total = weight + cost + (digits << BITS * (WIDTH - n - more))
                    if to not in after or total < after[to][0]:
                        after[to] = (total, n + more, origin)
            self.now[start] = after

    def _put_aside(self) -> None:
        mask = (1 << COST_AT) - 1
        for start, nodes in self.now.items():
            self.done[start].append({last: (origin, _letters(w, n)) for last, (w, n, origin) in nodes.items()})
            by_text = sorted(nodes, key=lambda last: nodes[last][0] & mask)
            self.now[start] = {last: ((nodes[last][0] >> COST_AT << COST_AT) + (rank << RANK_AT), 0, last)
                               for rank, last in enumerate(by_text)}
        self.turns = 0

    def ends(self) -> list[tuple[int, int, int, int, str]]:
        """For each start and last role: both, the cost, the rank of the letters among those of the start, the letters."""
        if self.turns:
            self._put_aside()
        out = []
        for start, nodes in self.now.items():
            for last, (weight, _, _) in nodes.items():
                at, pieces = last, []
                for chunk in reversed(self.done[start]):
                    at, letters = chunk[at]
                    pieces.append(letters)
                out.append((start, last, weight >> COST_AT, weight >> RANK_AT & 7, "".join(reversed(pieces))))
        return out


def _letters(weight: int, n: int) -> str:
    return "".join(LETTERS[weight >> BITS * (WIDTH - 1 - k) & 7] for k in range(n))


def cheapest(ends: list[tuple[int, int, int, int, str]]) -> tuple[int, str]:
    """The cost and letters of a whole conversation."""
    best = min(ends, key=lambda e: (e[2] + INSERT_COST * len(AT_END[e[1]]), e[3]))
    return best[2] + INSERT_COST * len(AT_END[best[1]]), best[4] + AT_END[best[1]]


def through_parts(parts: list[list[tuple[int, int, int, int]]]) -> tuple[int, list[tuple[int, int]]]:
    """The cost of a conversation, and for each part the last roles before and after it.

    A part has ends without their letters.
    """
    now, back = {NOTHING: (0, 0)}, []
    for ends in parts:
        after: dict[int, tuple[int, int, int, int]] = {}
        for start, last, cost, rank in ends:
            if start in now:
                weight = (now[start][0] + cost, now[start][1], rank, start)
                if last not in after or weight < after[last]:
                    after[last] = weight
        by_text = sorted(after, key=lambda last: after[last][1:3])
        back.append({last: after[last][3] for last in after})
        now = {last: (after[last][0], rank) for rank, last in enumerate(by_text)}
    total = {last: (cost + INSERT_COST * len(AT_END[last]), rank) for last, (cost, rank) in now.items()}
    last = min(total, key=total.get)
    cost, ways = total[last][0], []
    for step in reversed(back):
        ways.append((step[last], last))
        last = step[last]
    return cost, ways[::-1]


class _Part:
    """What one task has of a conversation, its turns taken in order."""

    def __init__(self, key, place: tuple, from_start: bool):
        self.key, self.place, self.from_start = key, place, from_start
        self.paths = Paths((NOTHING,) if from_start else (NOTHING, SYSTEM, USER, ASSISTANT))
        self.faults, self.illegal, self.distinct = [0, 0, 0, 0], 0, 0
        self.low = self.high = self.initials = None
        self.numbers: tuple | None = None  # the first and the last turn number, either may be null

    def add(self, turn, role: str, fault: int, copies: int) -> None:
        if not copies:
            return
        initial = role[:1]
        if self.initials is not None:
            self.illegal += self.initials[1] + initial not in LEGAL
        self.initials = (initial if self.initials is None else self.initials[0], initial)
        self.illegal += copies - 1
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.numbers = (turn if self.numbers is None else self.numbers[0], turn)
        self.faults[fault] += 1
        self.paths.add(BY_INITIAL.get(initial), fault)
        again = BLANK if fault == BLANK else DUPLICATE
        self.faults[again] += copies - 1
        for _ in range(copies - 1):
            self.paths.add(BY_INITIAL.get(initial), again)

    def row(self, part: int, whole: bool) -> tuple:
        ends, cost, letters = self.paths.ends(), None, None
        if whole:
            cost, letters = cheapest(ends)
        first, last = self.initials or (None, None)
        return (self.key, part, whole, *self.place, *self.faults[1:], self.illegal, first, last, self.low, self.high,
                self.distinct, *(self.numbers or (None, None)), cost, letters, None if whole else [dict(zip(("start", "last", "cost", "rank", "letters"), e, strict=True)) for e in ends])


def _parts(cells: DataFrame, kinds: tuple[DataType, DataType]) -> DataFrame:
    """One row for each conversation and task that has turns of it; ``cells`` are in order and dealt in ranges.

    Conversations that begin and end inside a task are decided; of the others there are two a task at most.
    """
    key_type, turn_type = (k.simpleString() for k in kinds)
    schema = (
        f"key {key_type}, part int, whole boolean, turn {turn_type}, role string, digest string, blank long, duplicate long,"
        f" truncated long, illegal long, first_initial string, last_initial string, low {turn_type}, high {turn_type},"
        f" n_turns long, first_turn {turn_type}, last_turn {turn_type}, cost long, letters string,"
        " ends array<struct<start:int,last:int,cost:long,rank:int,letters:string>>")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, rows, first = None, 0, [], True
        for batch in batches:
            for part, key, turn, role, digest, fault, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or key != now.key:
                    if now is not None:
                        rows.append(now.row(part, not first))
                        first = False
                    now = _Part(key, (turn, role, digest), from_start=now is not None)
                now.add(turn, role, fault, copies)
            if len(rows) >= ROWS_AT_ONCE:
                yield _columns(rows, _part_schema(batch.schema))
                rows = []
        if now is not None:
            rows.append(now.row(part, False))
            yield _columns(rows, _part_schema(batch.schema))

    return cells.mapInArrow(solve, schema)


def _part_schema(cells: pa.Schema) -> pa.Schema:
    end = pa.struct([("start", pa.int32()), ("last", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()), ("letters", pa.string())])
    turn, number, text = cells.field("turn").type, pa.int64(), pa.string()
    return pa.schema([
        ("key", cells.field("key").type), ("part", pa.int32()), ("whole", pa.bool_()), ("turn", turn), ("role", text),
        ("digest", text), ("blank", number), ("duplicate", number), ("truncated", number), ("illegal", number),
        ("first_initial", text), ("last_initial", text), ("low", turn), ("high", turn), ("n_turns", number),
        ("first_turn", turn), ("last_turn", turn), ("cost", number), ("letters", text), ("ends", pa.list_(end))])


def _joined(open_parts: DataFrame) -> DataFrame:
    """Of the parts of conversations that lie in several tasks: the way through each, and the totals in the first."""
    keep = open_parts.withColumn("ends", F.expr("transform(ends, e -> struct(e.start, e.last, e.cost, e.rank))"))
    key = open_parts.schema["key"].dataType.simpleString()

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        cost, ways = through_parts([[(e["start"], e["last"], e["cost"], e["rank"]) for e in r["ends"]] for r in rows])
        real = [r for r in rows if r["first_initial"] is not None]
        seams = list(zip(real, real[1:], strict=False))
        turns = [r for r in real if r["low"] is not None]
        gaps = turns[-1]["high"] - turns[0]["low"] + 1 - sum(r["n_turns"] for r in turns) if turns else 0
        # A turn number on both sides of a seam was counted twice.
        gaps += sum(a["last_turn"] is not None and a["last_turn"] == b["first_turn"] for a, b in seams)
        illegal = sum(r["illegal"] for r in real) + sum(a["last_initial"] + b["first_initial"] not in LEGAL for a, b in seams)
        totals = [gaps, *(sum(r[c] for r in real) for c in ("blank", "duplicate", "truncated")), illegal, cost]
        return pa.table({
            "key": pa.array([r["key"] for r in rows], table.schema.field("key").type),
            "part": pa.array([r["part"] for r in rows], pa.int32()),
            "start": pa.array([w[0] for w in ways], pa.int32()), "last": pa.array([w[1] for w in ways], pa.int32()),
            "at_end": pa.array([False] * (len(ways) - 1) + [True]),
            "totals": pa.array([totals] + [None] * (len(ways) - 1), pa.list_(pa.int64()))})

    # One row a task, without letters or texts, whatever the conversation's size.
    slim = keep.select("key", "part", "ends", "blank", "duplicate", "truncated", "illegal", "first_initial", "last_initial",
                       "low", "high", "n_turns", "first_turn", "last_turn")
    return slim.groupBy("key").applyInArrow(
        join, f"key {key}, part int, start int, last int, at_end boolean, totals array<long>")


def repair(turns: DataFrame, durable: Callable[..., DataFrame], key: str = "conv_id", turn: str = "turn",
           role: str = "role", text: str = "text", copies: str | None = None) -> DataFrame:
    """The repair stream of the conversations: key, place, role, text, totals (see above). In order inside partitions.

    Turns are in order of ``turn``, nulls first, then of role and the MD5 of the text. ``copies`` names a column that
    says how often a row stands there; a conversation all of whose rows stand there zero times has no turns. The first
    fault of a turn counts: blank (nothing but spaces), duplicate (role and text seen earlier), truncated (it does not end
    with one of ``.!?``). Blank and duplicate turns are deleted.

    Nulls in role and text are one space; null keys are one conversation. Repeated rows are duplicates of each other.
    An empty table gives no rows. Other columns are not read. Long texts pass one Arrow batch at a time; a
    conversation's turns may be spread over many tasks, for which only its letters, one a turn, meet in one place.
    """
    said, who = F.coalesce(F.col(text), F.lit(" ")), F.coalesce(F.col(role), F.lit(" "))
    bare = F.rtrim(said, F.lit(SPACES))
    whole = turns.select(
        F.col(key).alias("key"), F.col(turn).alias("turn"), who.alias("role"), F.md5(said).alias("digest"),
        said.alias("text"), (F.lit(1) if copies is None else F.col(copies)).cast("long").alias("copies"))
    fault = F.when(bare == "", BLANK).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), CUT).otherwise(FINE)
    marked = turns.select(
        F.col(key).alias("key"), F.col(turn).alias("turn"), who.alias("role"), F.md5(said).alias("digest"),
        fault.alias("fault"), (F.lit(1) if copies is None else F.col(copies)).cast("long").alias("copies"))
    # Equal rows are one cell, so no key holds more cells than it has different turns.
    cells = durable(marked.groupBy("key", "role", "digest", "turn").agg(
        F.first("fault").alias("fault"), F.sum("copies").alias("copies")), "turns")
    again = cells.filter("copies > 0").groupBy("key", "role", "digest").agg(
        F.max(F.col("turn").isNull()).alias("unnumbered"), F.min("turn").alias("earliest"), F.max("turn").alias("latest"),
    ).filter("unnumbered and latest is not null or earliest < latest").select(
        F.col("key").alias("of"), F.col("role").alias("by"), F.col("digest").alias("same"), "unnumbered", "earliest")
    match = F.col("key").eqNullSafe(F.col("of")) & (F.col("role") == F.col("by")) & (F.col("digest") == F.col("same"))
    seen = F.coalesce(F.col("turn").isNotNull() & (F.col("unnumbered") | (F.col("earliest") < F.col("turn"))), F.lit(False))
    order = ["key", "turn", "role", "digest"]
    dealt = (
        cells.join(again, match, "left")
        .withColumn("fault", F.when((F.col("fault") != BLANK) & seen, DUPLICATE).otherwise(F.col("fault")))
        .select(*order, "fault", "copies").repartitionByRange(*order).sortWithinPartitions(*order)
    )
    numbered = dealt.select(F.spark_partition_id().alias("part"), *order, "fault", "copies")
    kinds = (turns.schema[key].dataType, turns.schema[turn].dataType)
    parts = durable(_parts(numbered, kinds), "parts")
    totals = F.array(F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n_turns"), F.lit(0)).cast("long"),
                     *[F.col(c) for c in TOTALS[1:]])
    decided = parts.filter("whole").select(*order, F.col("letters").alias("text"), totals.alias("totals"))
    ways = _joined(parts.filter("not whole")).withColumnsRenamed({"key": "of", "part": "nth", "last": "to"})
    chosen = F.expr("filter(ends, e -> e.start = begins and e.last = to)[0].letters")
    ending = F.when(F.col("at_end"), F.get(F.array(*[F.lit(AT_END[k]) for k in range(4)]), F.col("to"))).otherwise("")
    spread = (
        parts.filter("not whole").join(
            ways.withColumnRenamed("start", "begins").withColumnRenamed("totals", "sums"),
            F.col("key").eqNullSafe(F.col("of")) & (F.col("part") == F.col("nth")))
        .select(*order, F.concat(chosen, ending).alias("text"), F.col("sums").alias("totals"))
    )
    heads = decided.unionByName(spread).select(*order, F.lit(0).alias("kind"), "text", F.lit(0).cast("long").alias("copies"), "totals")
    bodies = whole.filter("copies > 0").select(
        *order, F.lit(1).alias("kind"), "text", "copies", F.lit(None).cast("array<long>").alias("totals"))
    stream = heads.unionByName(bodies).repartition("key").sortWithinPartitions(*order, "kind")
    return stream.mapInArrow(_edited, f"key {kinds[0].simpleString()}, place long, role string, text string, totals array<long>") \
        .withColumnRenamed("key", key)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repair stream from turns in order with the letters of each part before them."""
    now, letters, last, place, none_yet = None, iter(""), NOTHING, 0, True
    for batch in batches:
        rows: list[tuple] = []
        schema = pa.schema([("key", batch.schema.field("key").type), ("place", pa.int64()), ("role", pa.string()),
                            ("text", pa.string()), ("totals", pa.list_(pa.int64()))])
        names = ("key", "role", "kind", "text", "copies", "totals")
        for key, role, kind, text, copies, totals in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if kind == 0:
                for _ in letters:  # insertions after the last turn of a conversation
                    place, last = place + 1, NEXT[last]
                    rows.append((now, place, ROLES[last], "", None))
                if none_yet or key != now:
                    now, last, place, none_yet = key, NOTHING, 0, False
                letters = iter(text)
                rows.append((key, 0, None, text, totals))
                continue
            for _ in range(copies):
                letter = next(letters)
                while letter == "I":
                    place, last = place + 1, NEXT[last]
                    rows.append((key, place, ROLES[last], "", None))
                    letter = next(letters)
                if letter == "D":
                    continue
                last = BY_INITIAL[role[0]] if letter == "K" else NEXT[last]
                place += 1
                rows.append((key, place, role if letter == "K" else ROLES[last], text, None))
        yield _columns(rows, schema)
    if not none_yet:
        rows = []
        for _ in letters:
            place, last = place + 1, NEXT[last]
            rows.append((now, place, ROLES[last], "", None))
        yield _columns(rows, schema)


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    values = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)


def repaired_turns(stream: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: key, place (from 1), role, text."""
    return stream.filter("place > 0").drop("totals")


def report(stream: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per conversation: its totals, ``audit`` (the letters) and ``repaired_sha256``, over ``role:text`` lines.

    Reads the stream once, as it lies in the partitions; of a conversation only its letters and a digest are held.
    """
    kind = stream.schema[key].dataType.simpleString()
    schema = f"key {kind}, {', '.join(f'{t} long' for t in TOTALS)}, audit string, repaired_sha256 string"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, none_yet, audit, totals, sha = None, True, [], None, hashlib.sha256()
        rows: list[tuple] = []
        for batch in batches:
            arrow = pa.schema([("key", batch.schema.field(0).type), *((t, pa.int64()) for t in TOTALS),
                               ("audit", pa.string()), ("repaired_sha256", pa.string())])
            for k, place, role, text, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place == 0:
                    if none_yet or k != now:
                        if not none_yet:
                            rows.append((now, *totals, "".join(audit), sha.hexdigest()))
                        now, none_yet, audit, totals, sha = k, False, [], sums, hashlib.sha256()
                    audit.append(text)
                else:
                    sha.update(f"{chr(10) if place > 1 else ''}{role}:{text}".encode())
            if len(rows) >= ROWS_AT_ONCE:
                yield _columns(rows, arrow)
                rows = []
        if not none_yet:
            rows.append((now, *totals, "".join(audit), sha.hexdigest()))
            yield _columns(rows, arrow)

    return stream.mapInArrow(digest, schema).withColumnRenamed("key", key)
