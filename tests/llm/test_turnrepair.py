"""Conversation repair: plain-Python search over all edits, blocks of every size, odd rows."""

import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest

from mailsift.llm import turnrepair

SPACE = " \t\n\v\f\r"
GIVEN = {"": "u", "s": "u", "u": "a", "a": "u"}
KEPT = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}


def least(rows):
    """(cost, audit) by backward recursion over whole strings."""

    @lru_cache(None)
    def after(at, state, inserts):
        ways = [(0, "")] if at == len(rows) and state in ("", "a") else []
        if inserts < 2:
            cost, audit = after(at, GIVEN[state], inserts + 1)
            ways.append((cost + 5, "I" + audit))
        if at < len(rows):
            role, fault = rows[at]
            cost, audit = after(at + 1, state, 0)
            ways.append((cost + 2, "D" + audit))
            extra = 5 if fault == "truncated" else 0
            if fault not in ("blank", "duplicate"):
                if (state, role[:1]) in KEPT:
                    cost, audit = after(at + 1, role[:1], 0)
                    ways.append((cost + extra, "K" + audit))
                cost, audit = after(at + 1, GIVEN[state], 0)
                ways.append((cost + 1 + extra, "R" + audit))
        return min(ways, default=(10**6, ""))

    return after(0, "", 0)


def expected(turns):
    """The report of one conversation's undamaged turns [(turn, role, text)]."""
    turns = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in turns]
    digest = lambda r, x: hashlib.md5(r.encode() + b"\0" + x.encode()).digest()
    turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), digest(x[1], x[2])))
    seen, rows = set(), []
    for _, role, text in turns:
        bare = text.strip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        rows.append((role, fault))
    cost, audit = least(tuple(rows))
    state, lines, left = "", [], iter(turns)
    for letter in audit:
        if letter == "I":
            state = GIVEN[state]
            lines.append({"u": "user:", "a": "assistant:"}[state])
            continue
        _, role, text = next(left)
        if letter == "K":
            state = role[:1]
            lines.append(f"{role}:{text}")
        elif letter == "R":
            state = GIVEN[state]
            lines.append({"u": "user:", "a": "assistant:"}[state] + text)
    known = [t for t, _, _ in turns if t is not None]
    number = lambda f: sum(x == f for _, x in rows)
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, number("blank"), number("duplicate"), number("truncated"), illegal, cost, audit, sha


def corpus(seed, conversations=60, longest=12):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randrange(1, longest)):
            at = None if rng.random() < 0.05 else turn + (rng.random() < 0.1)
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool", "", "s"])
            rows.append((conv, at, role, rng.choice(["Hi.", "Yes!", "no", "", " \n", "so it is. ", "Why?", None, "é…", "ok."])))
    return rows


def check(spark, rows, block):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS seq", "2 AS block", "3 AS conv")
    found = turnrepair.report(turns, turns, block).collect()
    by_conv = {}
    for conv, *turn in rows:
        by_conv.setdefault(conv, []).append(tuple(turn))
    assert len(found) == len(by_conv)
    for r in found:
        got = (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
        assert got == expected(by_conv[r.conv_id]), r.conv_id


@pytest.mark.parametrize("block", [turnrepair.BLOCK, 3, 1])
def test_against_brute_force(spark, block):
    check(spark, corpus(block), block)


def test_null_conversation_and_a_long_one(spark):
    rng = random.Random(9)
    long = [(None, t, rng.choice(["user", "assistant"]), rng.choice(["A.", "b", "C?", f"{t}!"])) for t in range(120)]
    check(spark, corpus(5, 4) + long, 16)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    some = spark.createDataFrame([(1, 0, "user", "Hi.")], none.schema)
    assert turnrepair.report(none, none).collect() == []
    row = turnrepair.report(none, some).first()
    assert (row.conv_id, row.cost, row.audit, row.repaired_sha256) == (1, 0, "", hashlib.sha256(b"").hexdigest())


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b! c?") for c in range(12) for t in range(12)] + [(None, 3, None, None), (4, None, "user", "x.")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for conv, turn, role, text in rows:
        filled = lambda x: " " if x is None else str(x)
        fate = zlib.crc32(f"{filled(conv)}:{filled(turn)}".encode()) % 20
        role, text = filled(role), filled(text)
        row = (conv, turn, "user" if fate == 4 else role, {1: "", 2: text.translate(str.maketrans("", "", ".!?"))}.get(fate, text))
        want += [row] * {0: 0, 3: 2}.get(fate, 1)
    assert sorted(map(str, turnrepair.damaged(turns).collect())) == sorted(f"Row(conv_id={a!r}, turn={b!r}, role={c!r}, text={d!r})" for a, b, c, d in want)


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Late."), (1, 1, "user", "Q?"), (1, 2, "user", "Again?"), (1, 3, "assistant", "Yes.")]
    done = turnrepair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = [(r.role, r.text) for r in done.rows().orderBy("block", "at", "step").collect()]
    assert found == [("user", "Late."), ("assistant", "Q?"), ("user", "Again?"), ("assistant", "Yes.")]


def test_ranks_order_whole_audits():
    """Arcs ranked by prefix doubling compare as the audits that begin with them."""
    rng = np.random.default_rng(2)
    grid = rng.choice([0, 1, 2, 3, 10, 11, 6, 5], (5, 9))
    cost = turnrepair.place_costs(grid, np.broadcast_to(turnrepair._END[:, None], (5, 4, 1)))[..., 0]
    arcs = turnrepair.ranked_arcs(grid, cost)
    starts = np.arange(5) * 10 * turnrepair.STATES
    for row, path in enumerate(arcs.paths(starts)):
        rows = tuple(("xsua"[c & 3], "blank" if c & 4 else "truncated" if c & 8 else None) for c in grid[row])
        audit = "".join(turnrepair.LETTERS[k] for k in arcs.letter[path] if k >= 0)
        want = least(rows)
        assert cost[row, 0, 0] == want[0] and want[1].startswith(audit) and set(want[1][len(audit) :]) <= {"I"}
