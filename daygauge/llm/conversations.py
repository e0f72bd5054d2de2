"""Repair of conversation structure by a run-length dynamic programme."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygauge.llm.common import partitions, query, sql_bytes, sql_crc32, table, written
from daygauge.session import durable

#: White space and the ends of sentences. Fixed values.
WHITE, ENDS = " \t\n\x0b\f\r", ".!?"
#: Costs of the edits, and what a truncated row costs that is not deleted. Fixed values.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: States of the repaired text: nothing yet, a system turn, a user turn, an assistant turn; the first and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or renamed turn: user and assistant take turns.
TURN = (USER, USER, ASSISTANT, USER)
NEVER = 1 << 60
ENDING = (0, NEVER, NEVER, 0)
#: Faults of a row that forbid keeping it come first; a symbol is an initial and one of these.
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)


def _kept(state: int, initial: str) -> int | None:
    """The state after a kept row, None where its role may not stand."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    if initial == "a":
        return ASSISTANT if state == USER else None
    return None


def _choices(state: int, symbol: tuple[str, int]) -> list[tuple[str, int, int, bool]]:
    """(letter, cost, next state, whether the row is used up) in the order of letters."""
    initial, fault = symbol
    out = [("D", DELETE, state, True), ("I", INSERT, TURN[state], False)]
    if fault in (FINE, TRUNCATED):
        extra = CUT if fault == TRUNCATED else 0
        after = _kept(state, initial)
        if after is not None:
            out.append(("K", KEEP + extra, after, True))
        out.append(("R", REROLE + extra, TURN[state], True))
    return out


def _times(a: tuple, b: tuple) -> tuple:
    """Min-plus product of matrices given as rows."""
    columns = range(len(b[0]))
    return tuple(tuple(min(x + r[k] for x, r in zip(row, b, strict=True)) for k in columns) for row in a)


def _before(matrix: tuple, after: tuple) -> tuple:
    """Cost to go before the rows of a matrix, from that after them."""
    return tuple(min(x + y for x, y in zip(row, after, strict=True)) for row in matrix)


@lru_cache(maxsize=4096)
def transition(symbol: tuple[str, int], power: int) -> tuple:
    """Cheapest way from state to state over 2**power rows of a symbol, with the turns inserted before each of them."""
    if power:
        half = transition(symbol, power - 1)
        return _times(half, half)
    rows = []
    for state in range(4):
        costs = [NEVER] * 4
        at, paid = state, 0
        for _ in range(3):  # a third inserted turn in a row comes back to a state for nothing
            for _, cost, after, used in _choices(at, symbol):
                if used:
                    costs[after] = min(costs[after], paid + cost)
            at, paid = TURN[at], paid + INSERT
        rows.append(tuple(costs))
    return tuple(rows)


def _powers(length: int) -> list[int]:
    return [p for p in range(length.bit_length()) if length >> p & 1]


def run_matrix(symbol: tuple[str, int], length: int) -> tuple:
    out = None
    for power in _powers(length):
        out = transition(symbol, power) if out is None else _times(out, transition(symbol, power))
    return out


def end_costs(after: tuple) -> tuple:
    """Cost to go where only turns may follow that are inserted."""
    costs = list(after)
    for _ in range(3):
        costs = [min(c, INSERT + costs[TURN[s]]) for s, c in enumerate(costs)]
    return tuple(costs)


#: Cost to go after the last row of a conversation.
LAST = end_costs(ENDING)


def _unroll(symbol: tuple[str, int], length: int, state: int, after: tuple, letters: list[str]) -> int:
    """Append the least letters among the cheapest over a run; return the state after it."""
    if length > 1:
        power = (length - 1).bit_length() - 1
        middle = after
        for p in _powers(length - (1 << power)):
            middle = _before(transition(symbol, p), middle)
        state = _unroll(symbol, 1 << power, state, middle, letters)
        return _unroll(symbol, length - (1 << power), state, after, letters)
    here = _before(transition(symbol, 0), after)
    while True:
        for letter, cost, following, used in _choices(state, symbol):
            if cost + (after if used else here)[following] == here[state]:
                letters.append(letter)
                state = following
                break
        if used:
            return state


def solve(runs: tuple, state: int = START, after: tuple = LAST, last: bool = True) -> tuple[int, str, int]:
    """(cost, audit, state after) of the cheapest edits over runs (symbol, length); of equals the ASCII-least audit.

    ``after`` is the cost to go behind the runs. With ``last`` the turns inserted behind the last row are written too.
    """
    behind = [after]
    for symbol, length in reversed(runs):
        here = behind[-1]
        for power in _powers(length):
            here = _before(transition(symbol, power), here)
        behind.append(here)
    cost = behind[-1][state]
    letters: list[str] = []
    for (symbol, length), here in zip(runs, reversed(behind[:-1]), strict=True):
        state = _unroll(symbol, length, state, here, letters)
    while last and ENDING[state]:
        letters.append("I")
        state = TURN[state]
    return cost, "".join(letters), state


_solved = lru_cache(maxsize=65536)(solve)


# ---------------------------------------------------------------- rows

def damage(rows: DataFrame) -> DataFrame:
    """Rows of ``conversations`` with the planted damage: conv_id, turn, role, text, n (0 dropped, 2 repeated).

    A null conversation, turn, role or text counts as one space in the key and as role and text; null turns stay null.
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    code = F.crc32(key) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return rows.select("conv_id", "turn", F.when(code == 4, "user").otherwise(role).alias("role"),
                       F.when(code == 1, "").when(code == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
                       F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("n"))


def _rows(rows: DataFrame, times: str | None) -> DataFrame:
    """The columns that count, nulls of role and text as one space, with a hash that stands for the text."""
    text = F.coalesce("text", F.lit(" "))
    n = F.lit(1) if times is None else F.col(times).cast("int")
    return rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"),
                       F.unhex(F.md5(text.cast("binary"))).alias("h"), n.alias("n"))


def _marked(rows: DataFrame) -> DataFrame:
    """Rows without their text, with the initial of the role and the fault that the text alone shows."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(*ENDS), FINE).otherwise(TRUNCATED)
    return rows.select("conv_id", *ORDER, F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "n")


ORDER = ("turn", "role", "h")
SEGMENT = ("conv_id bigint, part int, whole boolean, blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, low bigint, "
           "high bigint, first string, last string, first_turn bigint, last_turn bigint, cost bigint, audit string, runs string, matrix string")


class _Segment:
    """Adjoining rows of one conversation in one task."""

    def __init__(self, conv_id):
        self.conv_id, self.whole = conv_id, True
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.first = self.last = self.first_turn = self.last_turn = None
        self.runs: list[list] = []

    def add(self, turn, initial: str, fault: int, first: bool, n: int) -> None:
        if not n:
            return
        if self.first is None:
            self.first, self.first_turn = initial, turn
        else:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.illegal += (n - 1) * (initial + initial not in ("su", "ua", "au"))
        if turn is not None:
            if self.turns == 0 or turn != self.last_turn:
                self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.last, self.last_turn = initial, turn
        if fault == BLANK:
            self.blank += n
            self._run(("", BLANK), n)
            return
        new = int(first)
        self.duplicate += n - new
        if new:
            self.truncated += fault == TRUNCATED
            self._run((initial if initial in ("s", "u", "a") else "", fault), 1)
        if n > new:
            self._run(("", DUPLICATE), n - new)

    def _run(self, symbol: tuple[str, int], n: int) -> None:
        symbol = (symbol[0], BLANK) if symbol[1] == DUPLICATE else symbol
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += n
        else:
            self.runs.append([symbol, n])

    def row(self, part: int) -> tuple:
        runs = tuple((s, n) for s, n in self.runs)
        cost = audit = matrix = kept = None
        if self.whole:
            cost, audit, _ = _solved(runs) if len(runs) <= 64 else solve(runs)
        else:
            out = None
            for symbol, n in runs:
                out = run_matrix(symbol, n) if out is None else _times(out, run_matrix(symbol, n))
            matrix, kept = json.dumps(out), json.dumps(runs)
        return (self.conv_id, part, self.whole, self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.low, self.high, self.first,
                self.last, self.first_turn, self.last_turn, cost, audit, kept, matrix)


def _segments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per conversation of a task. The first and the last may go on in another task: they are not solved, but keep their runs and matrix."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = [f.split()[0] for f in SEGMENT.split(", ")]
    kinds = [{"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}[f.split()[1]] for f in SEGMENT.split(", ")]
    done: list[tuple] = []
    now: _Segment | None = None

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
        done.clear()
        return out

    for batch in it:
        for conv_id, turn, initial, fault, first, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault", "first", "n")), strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now.row(part))
                opening = now is None
                now = _Segment(conv_id)
                now.whole = not opening
            now.add(turn, initial, fault, first, n)
        if len(done) >= 4096:
            yield flush()
    if now is not None:
        now.whole = False
        done.append(now.row(part))
    if done:
        yield flush()


def _grouped(fn: Callable[[list[dict]], list[tuple]], schema: str):
    """A function for applyInArrow from one on the rows of a group in the order of ``part``."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [{"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[f.split()[1]] for f in schema.split(", ")]

    def run(rows: pa.Table) -> pa.Table:
        out = fn(sorted(rows.to_pylist(), key=lambda r: r["part"]))
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return run


def _costs_behind(rows: list[dict]) -> list[tuple]:
    """For each segment of a conversation the cost to go behind it, and the cost of the whole."""
    after, out = LAST, []
    for r in reversed(rows):
        out.append((r["conv_id"], r["part"], json.dumps(after)))
        after = _before(json.loads(r["matrix"]), after)
    return [(*o, after[START]) for o in out]


def _entries(rows: list[dict]) -> list[tuple]:
    """The state in which each segment of a conversation is entered."""
    state, out = START, []
    for r in rows:
        out.append((r["conv_id"], r["part"], state))
        state = json.loads(r["exits"])[state]
    return out


def _joined_stats(rows: list[dict]) -> list[tuple]:
    """What adjoining segments share: illegal pairs across their border, turns counted on both sides, the whole range of turns."""
    illegal = turns = 0
    for a, b in zip(rows, rows[1:], strict=False):
        illegal += a["last"] + b["first"] not in ("su", "ua", "au")
        turns += a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    return [(rows[0]["conv_id"], illegal, turns)]


def _open_exits(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each segment that is not whole: from each state the state behind it and the letters."""
    for batch in it:
        exits, audits = [], []
        for runs, after in zip(batch.column("runs").to_pylist(), batch.column("behind").to_pylist(), strict=True):
            after = tuple(json.loads(after))
            parsed = tuple(((s[0], s[1]), n) for s, n in json.loads(runs))
            ways = [solve(parsed, state, after, last=False) for state in range(4)]
            exits.append(json.dumps([w[2] for w in ways]))
            audits.append([w[1] for w in ways])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), pa.array(exits), pa.array(audits, pa.list_(pa.string()))],
                                         names=["conv_id", "part", "exits", "ways"])


def _open_conversations(segments: DataFrame) -> DataFrame:
    """Conversations of the first and last segments of tasks, carried over their segments: a small row per task and conversation."""
    open_ = segments.where("NOT whole")
    kinds = "conv_id bigint, part int, behind string, cost bigint"
    behind = (open_.select("conv_id", "part", "matrix").groupBy("conv_id").applyInArrow(_grouped(_costs_behind, kinds), kinds)
              .select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), "behind", F.col("cost").alias("_cost")))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p"))
    costs = behind.groupBy("_c").agg(F.max("_cost").alias("cost")).select(F.col("_c").alias("_k"), "cost")
    ways = written(open_.select("conv_id", "part", "runs").join(behind, same).select("conv_id", "part", "runs", "behind")
                   .mapInArrow(_open_exits, "conv_id bigint, part int, exits string, ways array<string>"), "ways")
    kinds = "conv_id bigint, part int, state int"
    entries = (ways.select("conv_id", "part", "exits").groupBy("conv_id").applyInArrow(_grouped(_entries, kinds), kinds)
               .select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), "state"))
    chosen = ways.join(entries, same).select("conv_id", "part", F.get("ways", F.col("state")).alias("letters"),
                                             F.get(F.from_json("exits", "array<int>"), F.col("state")).alias("exit"))
    pieces = F.array_sort(F.collect_list(F.struct("part", "letters")))
    tail = F.get(F.array(*[F.lit(solve((), s)[1]) for s in range(4)]), F.col("_exit"))
    audits = (chosen.groupBy("conv_id").agg(F.array_join(F.transform(pieces, lambda s: s["letters"]), "").alias("_letters"), F.max_by("exit", "part").alias("_exit"))
              .select(F.col("conv_id").alias("_c"), F.concat("_letters", tail).alias("audit")))
    kinds = "conv_id bigint, illegal bigint, turns bigint"
    borders = (open_.select("conv_id", "part", "first", "last", "first_turn", "last_turn").groupBy("conv_id").applyInArrow(_grouped(_joined_stats, kinds), kinds)
               .select(F.col("conv_id").alias("_b"), F.col("illegal").alias("_illegal"), F.col("turns").alias("_turns")))
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns")]
    wide = open_.groupBy("conv_id").agg(*sums, F.min("low").alias("low"), F.max("high").alias("high"))
    for other, key in ((audits, "_c"), (borders, "_b"), (costs, "_k")):
        wide = wide.join(other, F.col("conv_id").eqNullSafe(F.col(key)))
    return wide.withColumns({"illegal": F.col("illegal") + F.col("_illegal"), "turns": F.col("turns") - F.col("_turns")})


REPORT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def repair_report(rows: DataFrame, times: str | None = None) -> DataFrame:
    """Faults, cheapest repair and its audit for each conversation of rows (conv_id, turn, role, text).

    With ``times`` a row counts as often as that column says (0: its conversation is known, the row is not there). Rows are ordered
    by turn, null turns first, then role and a hash of the text; rows alike in all of these are interchangeable, and are counted
    before they are shuffled. A row's first fault counts: blank, duplicate (role and text stood before), truncated. Keep costs 0,
    Rerole 3, Delete 4 (a must for blank and duplicate rows), Insert 3, a truncated row that stays 3; the initials of the roles that
    are left must be ``(s?(ua)+)?``.

    Equal consecutive symbols are one run; a run is passed by cached binary powers of its min-plus transition, and the letters are
    unrolled from the costs to go. Rows are dealt by range of conversation and turn, so a very long conversation spreads over tasks:
    its segments give one matrix each, costs and states are carried over segments, and tasks unroll the letters.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, one row per conversation (null is one). Conversations
    without a row have zeros and an empty audit; an empty table gives no rows; a null role or text is one space; other columns
    are ignored.
    """
    spark = rows.sparkSession
    marked = _marked(_rows(rows, times))
    counted = marked.groupBy("conv_id", *ORDER, "initial", "fault").agg(F.sum("n").cast("bigint").alias("n")).where("n > 0")
    known = counted.where(F.col("fault") != BLANK).groupBy("conv_id", "role", "h").agg(
        F.count("*").alias("times"), F.count("turn").alias("timed"), F.min("turn").alias("least"))
    again = known.where("times > 1").select(
        F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("h").alias("_h"),
        F.when(F.col("timed") == F.col("times"), F.col("least")).alias("_least"), F.lit(True).alias("_again"))
    joined = counted.join(again, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("h") == F.col("_h")), "left")
    first = F.col("_again").isNull() | F.col("turn").eqNullSafe(F.col("_least"))
    place = ["conv_id", *ORDER]
    placed = durable(joined.select("conv_id", *ORDER, "initial", "fault", first.alias("first"), "n")
                     .repartitionByRange(partitions(spark), *place).sortWithinPartitions(*place).select("conv_id", "turn", "initial", "fault", "first", "n"))
    segments = written(placed.mapInArrow(_segments, SEGMENT), "segments")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    columns = ["conv_id", gaps, *REPORT[2:]]
    found = segments.where("whole").select(*columns).unionAll(_open_conversations(segments).select(*columns))
    if times is None:
        return found
    none = rows.groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(F.max(times).alias("_most")).where("_most = 0")
    zeros = [F.lit(0).cast("bigint").alias(c) for c in REPORT[1:-1]]
    return found.unionAll(none.select("conv_id", *zeros, F.lit("").alias("audit")))


def _edited(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that are left, from an audit and then the rows of its conversation in order."""
    conv_id, state, letters = None, START, iter("")
    out: list[tuple] = []
    place = 0

    def add(role: str, text: str, edit: str) -> None:
        nonlocal place
        out.append((conv_id, place, role, text, edit))
        place += 1

    def turn(text: str, edit: str) -> None:
        nonlocal state
        state = TURN[state]
        add("user" if state == USER else "assistant", text, edit)

    def flush() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                                           names=["conv_id", "place", "role", "text", "edit"])
        out.clear()
        return batch

    for batch in it:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text", "n")]
        for id_, audit, role, text, n in zip(*columns, strict=True):
            if audit is not None:
                for _ in letters:
                    turn("", "I")
                conv_id, state, letters, place = id_, START, iter(audit), 0
                continue
            for _ in range(n):
                letter = next(letters)
                while letter == "I":
                    turn("", "I")
                    letter = next(letters)
                if letter == "K":
                    state = _kept(state, role[:1])
                    add(role, text, "K")
                elif letter == "R":
                    turn(text, "R")
            if len(out) >= 1024:
                yield flush()
    for _ in letters:
        turn("", "I")
    if out:
        yield flush()


def repaired_turns(rows: DataFrame, report: DataFrame, times: str | None = None) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text, edit (I, K or R), from the rows and their ``repair_report``.

    Each task streams whole conversations, the audit first and then the rows in order, and keeps neither; a conversation's rows come
    out in order and next to each other.
    """
    texts = _rows(rows, times).where("n > 0")
    audits = report.select("conv_id", "audit", *[F.lit(None).cast(k).alias(c) for c, k in (("turn", "bigint"), ("role", "string"), ("h", "binary"),
                                                                                         ("text", "string"), ("n", "int"))])
    both = audits.unionByName(texts.withColumn("audit", F.lit(None).cast("string")))
    placed = both.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *ORDER)
    return placed.select("conv_id", "audit", "role", "text", "n").mapInArrow(_edited, "conv_id bigint, place bigint, role string, text string, edit string")


def _digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A hash per conversation of its newline-joined turns; the conversation's rows adjoin."""
    now = None
    for batch in it:
        done = []
        for conv_id, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")), strict=True):
            if place == 0:
                if now is not None:
                    done.append((now[0], now[1].hexdigest()))
                now = conv_id, hashlib.sha256()
            now[1].update((("\n" if place else "") + role + ":" + text).encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done])], names=["conv_id", "sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1].hexdigest()])], names=["conv_id", "sha256"])


SQL = f"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {sql_crc32(sql_bytes("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"))} % 20 AS code FROM conversations),
damaged AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
  CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed, unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copies(copy)),
numbers AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS pos,
  left(role, 1) AS initial FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair FROM numbers),
faults AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 2 WHEN nth > 1 THEN 3
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 1 ELSE 0 END AS fault FROM seen),
stats AS (SELECT conv_id, count(*) AS n_rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
  count(*) FILTER (WHERE fault = 2) AS blank, count(*) FILTER (WHERE fault = 3) AS duplicate, count(*) FILTER (WHERE fault = 1) AS truncated,
  count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id),
inserts(f, letters, price, g, added) AS (VALUES (0, '', 0, 0, []::VARCHAR[]), (0, 'I', 3, 2, ['user:']), (0, 'II', 6, 3, ['user:', 'assistant:']),
  (1, '', 0, 1, []), (1, 'I', 3, 2, ['user:']), (1, 'II', 6, 3, ['user:', 'assistant:']), (2, '', 0, 2, []), (2, 'I', 3, 3, ['assistant:']),
  (2, 'II', 6, 2, ['assistant:', 'user:']), (3, '', 0, 3, []), (3, 'I', 3, 2, ['user:']), (3, 'II', 6, 3, ['user:', 'assistant:'])),
steps AS (SELECT i.*, e.letter FROM inserts i, (VALUES ('D'), ('K'), ('R')) AS e(letter)),
dp AS (
  SELECT conv_id, 0::BIGINT AS pos, 0 AS state, {{'cost': 0, 'audit': '', 'lines': []::VARCHAR[]}} AS best FROM stats
  UNION ALL
  SELECT conv_id, pos, state, min({{'cost': cost, 'audit': audit, 'lines': lines}}) FROM (
    SELECT d.conv_id, r.pos,
      CASE s.letter WHEN 'D' THEN s.g WHEN 'K' THEN CASE r.initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE s.g WHEN 2 THEN 3 ELSE 2 END END AS state,
      d.best.cost + s.price + CASE s.letter WHEN 'D' THEN 4 WHEN 'K' THEN 0 ELSE 3 END + CASE WHEN s.letter <> 'D' AND r.fault = 1 THEN 3 ELSE 0 END AS cost,
      d.best.audit || s.letters || s.letter AS audit,
      list_concat(list_concat(d.best.lines, s.added), CASE s.letter WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [r.role || ':' || r.text]
        ELSE [CASE s.g WHEN 2 THEN 'assistant:' ELSE 'user:' END || r.text] END) AS lines
    FROM dp d JOIN faults r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.pos = d.pos + 1 JOIN steps s ON s.f = d.state
    WHERE s.letter = 'D' OR (r.fault < 2 AND (s.letter = 'R' OR (r.initial = 's' AND s.g = 0) OR (r.initial = 'u' AND s.g <> 2) OR (r.initial = 'a' AND s.g = 2))))
  GROUP BY conv_id, pos, state),
ends AS (SELECT d.conv_id, min({{'cost': d.best.cost + i.price, 'audit': d.best.audit || i.letters, 'lines': list_concat(d.best.lines, i.added)}}) AS best
  FROM dp d JOIN stats t ON t.conv_id IS NOT DISTINCT FROM d.conv_id AND d.pos = t.n_rows
  JOIN inserts i ON i.f = d.state AND (i.g = 3 OR (i.f = 0 AND i.g = 0)) GROUP BY d.conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(e.best.cost, 0)::BIGINT AS cost, coalesce(e.best.audit, '') AS audit,
  sha256(coalesce(array_to_string(e.best.lines, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN stats t ON t.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM ids.conv_id"""


@query("op12_conversations", SQL)
def op12_conversations(spark, sf_dir):
    rows = damage(table(spark, sf_dir, "conversations"))
    report = written(repair_report(rows, "n"), "report")
    digests = repaired_turns(rows, report, "n").mapInArrow(_digests, "conv_id bigint, sha256 string").select(F.col("conv_id").alias("_c"), "sha256")
    return report.join(digests, F.col("conv_id").eqNullSafe(F.col("_c")), "left").select(
        *REPORT, F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
