"""Repair of conversations against a plain forward search over edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest

from daygauge.llm import conversations as cv

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n int, audit string, part int, first boolean"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def plain_repair(rows):
    """Forward search that carries the cheapest (cost, audit, lines) of each way the roles may stand."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
    counts, seen, faults = [0, 0, 0], set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        counts[0] += fault == "blank"
        counts[1] += fault == "duplicate"
        counts[2] += fault == "truncated"
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    roles = {"u": "user", "a": "assistant"}

    def may_follow(initials, new):
        return {"": "su", "s": "u", "u": "a", "a": "u"}[initials][0:].find(new) >= 0

    ways = {"": (0, "", ())}  # by the last initial

    def insert(ways):
        ways = dict(ways)
        for _ in range(3):
            for last, (cost, audit, lines) in list(ways.items()):
                for new in "ua":
                    if may_follow(last, new):
                        way = (cost + 3, audit + "I", (*lines, roles[new] + ":"))
                        ways[new] = min(ways.get(new, way), way)
        return ways

    for (_, _, role, text), fault in zip(rows, faults):
        after = {}

        def take(last, way):
            after[last] = min(after.get(last, way), way)

        for last, (cost, audit, lines) in insert(ways).items():
            take(last, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault else 0
            if role[:1] in ("s", "u", "a") and may_follow(last, role[:1]):
                take(role[:1], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
            for new in "ua":
                if may_follow(last, new):
                    take(new, (cost + 3 + more, audit + "R", (*lines, f"{roles[new]}:{text}")))
        ways = after
    best = min(way for last, way in insert(ways).items() if last in ("", "a"))
    return (gaps, *counts, illegal, best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest())


def expected(rows):
    damaged = defaultdict(list)
    for r in plain_damage(rows):
        damaged[r[0]].append(r)
    zero = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    return {conv: plain_repair(damaged[conv]) if damaged[conv] else zero for conv in {r[0] for r in rows}}


def make_rows(seed, conversations, length):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(conversations)]:
        for turn in range(rng.randrange(1, length)):
            turn = rng.choice([turn, turn, turn, None, turn // 2])
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]),
                         rng.choice(["Yes.", "No!", "a b", " \t\n", "", None, "What?", "end. \n", "é漢 …", "Yes."])))
    return rows


@pytest.fixture
def conversations(spark, tmp_path):
    def make(rows):
        path = str(tmp_path / "conversations.parquet")
        full = [(*r, 9, "x", 4, True) for r in rows]
        spark.createDataFrame(full, SCHEMA).write.mode("overwrite").parquet(path)
        return str(tmp_path)

    return make


def result(spark, sf_dir):
    got = cv.op12_conversations(spark, sf_dir).collect()
    found = {r["conv_id"]: tuple(r)[1:] for r in got}
    assert len(found) == len(got)
    return found


@pytest.mark.parametrize("partitions", ["1", "3", "7"])
def test_repair_is_the_plain_search(spark, conversations, partitions):
    rows = make_rows(int(partitions), 60, 14)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert result(spark, conversations(rows)) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_conversation_over_all_tasks(spark, conversations):
    rng = random.Random(2)
    rows = [(5, t, "user" if t < 900 or t % 2 else "assistant", rng.choice(["So.", "So.", f"{t}.", f"{t}", ""])) for t in range(1500)]
    rows += [(5, 700, "user", "the same.")] * 400 + [(4, 1, "user", "a."), (6, 1, "user", "b."), (6, 2, "assistant", "c.")]
    assert result(spark, conversations(rows)) == expected(rows)


def test_runs_are_passed_by_powers():
    rng = random.Random(8)
    symbols = [(i, f) for i, f in product(["s", "u", "a", ""], [cv.FINE, cv.TRUNCATED])] + [("", cv.BLANK)]
    for _ in range(300):
        runs = tuple((rng.choice(symbols), rng.choice([1, 1, 2, 3, 8, 13])) for _ in range(rng.randrange(1, 6)))
        single = tuple((s, 1) for s, n in runs for _ in range(n))
        assert cv.solve(runs) == cv.solve(single)
        whole = cv.run_matrix(*runs[0])
        for run in runs[1:]:
            whole = cv._times(whole, cv.run_matrix(*run))
        assert cv._before(whole, cv.LAST)[cv.START] == cv.solve(runs)[0]


def test_turns_without_damage(spark, documents):
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", 7), (1, 1, "user", "And?", 7), (2, 0, "system", "Be kind.", 7)],
                                 "conv_id bigint, turn bigint, role string, text string, place int")
    report = cv.repair_report(rows).collect()
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in report} == {1: (3, "KR"), 2: (4, "D")}
    turns = cv.repaired_turns(rows, cv.repair_report(rows)).collect()
    assert [tuple(t) for t in turns] == [(1, 0, "user", "Hi.", "K"), (1, 1, "assistant", "And?", "R")]
    assert cv.repair_report(rows.limit(0)).count() == 0
