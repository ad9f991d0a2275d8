"""Repair of conversation structure at least cost, with the least audit trail among the cheapest.

A conversation's turns are edited until the role initials read ``(s?(ua)+)?``: Keep (K) costs 0, Rerole (R) to user or
assistant 1, Delete (D) 2, Insert (I) of an empty user or assistant turn 5; blank and repeated turns must go, and a
truncated turn that stays adds 5. The audit is the string of edit initials; of all cheapest ones the least in ASCII
order is taken. What has been read so far is one of four states (start, after system, after user, after assistant); a
state decides which role an edit gives, so an audit decides the repair.

Method. Turns are numbered within their conversation and cut into blocks of ``BLOCK``. The cost DP runs backwards over
all blocks of a batch at once and gives, for each of four states at a block's right edge, the cost from each state at
its left edge; a conversation's blocks are then chained, which leaves every block the true cost to the end at its right
edge. Arcs that lie on a cheapest way are kept and ranked by prefix doubling: first by their own initial, then by the
ranks of the arc and of the arc that doubled pointers reach from it, for audits of 2, 4, 8, ... edits. The least-ranked
arc of a node starts its least audit; the pointers, doubled again, list the whole path.

Scale: conversations of any length are spread over tasks, by range partitions for the numbering and by blocks for
the rest; only one row of 16 costs a block, and the audit itself, meet per conversation. Whether a turn was seen before
is the minimum over (conversation, digest of role and text), which pre-aggregates, joined back by a row number; so
one very common turn is no hot key. Texts are shuffled for the repaired lines only; the digest of a repaired
conversation is by definition one sequential pass over its lines, streamed with a hash state as the only memory.

Order of turns: by turn, nulls first; ties by role, then by the MD5 of role and text, and equal turns are alike.
Nulls: a null role or text is one space (so a null text is blank); a null turn takes part but in ``gaps``; a null
conv_id is a conversation of its own. Empty texts are blank, very long ones are handled whole. Roles are judged by
their first character, exactly as written; any other initial than s, u or a can only be reroled or deleted. An empty
table gives no rows. Extra columns, of any name, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mailsift.llm.storage import stored
from mailsift.llm.words import in_small_batches, tidy
from mailsift.operators.ordered import positions

BLOCK = 256
KEEP, REROLE, DELETE, INSERT, STAYS = 0, 1, 2, 5, 5
WHITE = r"\x20\x09-\x0D"

#: States: start, after system, after user, after assistant. What a turn of each initial (none, s, u, a) leads to when kept.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
_KEPT = np.full((STATES, 4), -1)
_KEPT[START, 1], _KEPT[START, 2], _KEPT[SYSTEM, 2], _KEPT[USER, 3], _KEPT[ASSISTANT, 2] = SYSTEM, USER, USER, ASSISTANT, USER
#: Where a reroled or inserted turn leads, and the role it then has.
_GIVEN = np.array([USER, USER, ASSISTANT, USER])
ROLES = np.array(["user", "user", "assistant", "user"])
#: Cost and audit of what is left after the last turn.
_END = np.array([0, 2 * INSERT, INSERT, 0])
TAILS = np.array(["", "II", "I", ""])
FAR = 1 << 50
LETTERS = "DIKR"
_GONE, _CUT = 4, 8


def damaged(turns: DataFrame) -> DataFrame:
    """The turns as the damage leaves them, by crc32 of ``conv_id:turn`` modulo 20."""
    filled = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text"))
    times = F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return turns.filter(fate != 0).select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(filled("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy")
    ).drop("copy")


def _numbered(turns: DataFrame) -> DataFrame:
    """Turns without nulls in role and text, with a key of their conversation, a row number and a digest."""
    filled = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    rows = turns.select("conv_id", "turn", filled("role"), filled("text"))
    key = F.when(F.col("conv_id").isNull(), "null").otherwise(F.concat(F.lit("id "), F.col("conv_id").cast("string")))
    both = F.concat(F.encode("role", "utf-8"), F.unhex(F.lit("00")), F.encode("text", "utf-8"))
    return rows.withColumns({"conv": key, "seq": F.monotonically_increasing_id(), "digest": F.unhex(F.md5(both))})


def with_faults(numbered: DataFrame) -> DataFrame:
    """``numbered`` without texts and with the first fault of every turn: blank, duplicate, truncated or null."""
    rows = numbered.withColumn("last", F.regexp_extract("text", rf"(?s)([^{WHITE}])[{WHITE}]*$", 1)).drop("text")
    first = numbered.groupBy("conv", "digest").agg(F.min(F.struct("turn", "seq")).alias("least")).select("least.seq", F.lit(True).alias("first"))
    fault = (
        F.when(F.col("last") == "", "blank").when(F.col("first").isNull(), "duplicate")
        .when(~F.col("last").isin(".", "!", "?"), "truncated")
    )
    return rows.join(first, "seq", "left").withColumn("fault", fault).drop("first", "last")


def _code(role: Column, fault: Column) -> Column:
    """A turn as a small number: its initial (1 s, 2 u, 3 a), 4 if it must go, 8 if staying costs."""
    initial = F.substring(role, 1, 1)
    return (
        F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
        + F.when(fault.isin("blank", "duplicate"), _GONE).when(fault == "truncated", _CUT).otherwise(0)
    ).cast("int")


def _blocks(faulty: DataFrame, block: int) -> DataFrame:
    """conv, block, blocks (of the conversation), first (its first row number) and its row numbers and codes, in order."""
    placed = positions(faulty, ["conv", "turn", "role", "digest", "seq"], ["conv"])
    at = F.col("position") - 1
    item = F.struct((at % block).alias("at"), "seq", _code(F.col("role"), F.col("fault")).alias("code"))
    made = placed.groupBy("conv", F.floor(at / block).alias("block")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    counted = made.groupBy("conv").agg(F.count("*").alias("blocks"))
    return made.join(counted, "conv").select(
        "conv", "block", "blocks", F.col("items")[0]["seq"].alias("first"), F.col("items.seq").alias("seqs"), F.col("items.code").alias("codes")
    )


def _inserted(cost: np.ndarray) -> np.ndarray:
    """Costs (block, state, target) once turns may be inserted; two inserts reach every state that inserts reach."""
    for _ in range(2):
        cost = np.minimum(cost, INSERT + cost[:, _GIVEN])
    return cost


def _moves(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For turns of these codes and each state: where Keep leads (-1: nowhere), and what Keep and Rerole cost."""
    known = np.maximum(code, 0)
    stay = np.where(known & _GONE, FAR, np.where(known & _CUT, STAYS, 0))[:, None]
    to = _KEPT.T[known & 3]
    return to, np.where(to < 0, FAR, KEEP + stay), np.broadcast_to(REROLE + stay, to.shape)


def place_costs(grid: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least costs (block, place, state, target) from before every place to each target column of ``right``.

    ``grid`` holds the codes of a block's turns, right-aligned, -1 before the first; ``right`` is (block, state, target).
    """
    width = grid.shape[1]
    cost, out = right, [right]
    every = np.arange(len(grid))[:, None]
    for at in range(width - 1, -1, -1):
        to, keep, rerole = _moves(grid[:, at])
        stay = np.minimum(keep[..., None] + cost[every, np.maximum(to, 0)], rerole[..., None] + cost[:, _GIVEN])
        best = _inserted(np.minimum(np.minimum(DELETE + cost, stay), FAR))
        cost = np.where((grid[:, at] >= 0)[:, None, None], best, cost)
        out.append(cost)
    return np.stack(out[::-1], axis=1)


@dataclass
class Arcs:
    """Cheapest arcs of all nodes (block, place, state), numbered in that order; the last arc is the end and leads to itself."""

    letter: np.ndarray
    target: np.ndarray
    best: np.ndarray
    pointers: list[np.ndarray]

    def paths(self, start: np.ndarray) -> np.ndarray:
        """Arcs of the least path from each start node, ended by the end arc; doubled pointers double the known part."""
        known = self.best[start][:, None]
        for pointer in self.pointers:
            known = np.concatenate([known, pointer[known]], axis=1)
        return known


def _least_arcs(source: np.ndarray, rank: np.ndarray, nodes: int) -> np.ndarray:
    """The least-ranked arc of every node, the end arc where it has none."""
    end = len(source)
    order = np.lexsort((rank[:end], source))
    head = np.ones(end, bool)
    head[1:] = source[order[1:]] != source[order[:-1]]
    best = np.full(nodes, end)
    best[source[order[head]]] = order[head]
    return best


def ranked_arcs(grid: np.ndarray, cost: np.ndarray) -> Arcs:
    """Arcs on cheapest ways, ranked by the audits that begin with them. ``cost`` is (block, place, state).

    A node's arcs have different letters, so its least arc for one edit stays the least for longer audits.
    """
    blocks, width = grid.shape
    node = np.arange(blocks * (width + 1) * STATES).reshape(blocks, width + 1, STATES)
    here, ahead = cost[:, :-1], cost[:, 1:]
    to, keep, rerole = (x.reshape(blocks, width, STATES) for x in _moves(grid.ravel()))
    kept, live = np.maximum(to, 0), (grid >= 0)[..., None] & (here < FAR)
    source, letter, target = [], [], []
    for number, price, goal, rest in (
        (0, DELETE, node[:, 1:], ahead),
        (1, INSERT, node[:, :-1][..., _GIVEN], here[..., _GIVEN]),
        (2, keep, np.take_along_axis(node[:, 1:], kept, 2), np.take_along_axis(ahead, kept, 2)),
        (3, rerole, node[:, 1:][..., _GIVEN], ahead[..., _GIVEN]),
    ):
        cheapest = live & (price + rest == here)
        source.append(node[:, :-1][cheapest])
        target.append(goal[cheapest])
        letter.append(np.full(len(source[-1]), number))
    source, letter, target = np.concatenate(source), np.append(np.concatenate(letter), -1), np.concatenate(target)
    rank = letter + 1
    best = _least_arcs(source, rank, node.size)
    pointer = np.append(best[target], len(source))
    pointers = []
    while (pointer[best] < len(source)).any():
        pointers.append(pointer)
        rank = np.unique(rank * np.int64(len(rank) + 1) + rank[pointer], return_inverse=True)[1]
        pointer = pointer[pointer]
    pointers.append(pointer)
    return Arcs(letter, np.append(target, -1), _least_arcs(source, rank, node.size), pointers)


def _grid(codes: list[np.ndarray]) -> np.ndarray:
    grid = np.full((len(codes), max(map(len, codes))), -1)
    for row, values in enumerate(codes):
        grid[row, grid.shape[1] - len(values) :] = values
    return grid


def _alike(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Blocks of a batch in groups of about the same number of turns."""
    codes = [np.asarray(c, np.int64) for c in batch.column("codes").to_pylist()]
    sizes = np.array([len(c).bit_length() for c in codes])
    for size in np.unique(sizes):
        chosen = np.flatnonzero(sizes == size)
        for some in np.array_split(chosen, (len(chosen) << int(size)) // 8192 + 1):
            if len(some):
                yield batch.take(pa.array(some)), [codes[k] for k in some]


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's cost from every state at its left to every state at its right."""
    unit = np.where(np.eye(STATES, dtype=bool), 0, FAR)
    for batch in batches:
        for some, codes in _alike(batch):
            cost = place_costs(_grid(codes), np.broadcast_to(unit, (len(codes), STATES, STATES)))[:, 0]
            flat = pa.array(list(cost.reshape(len(codes), -1)), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column("conv"), some.column("block"), some.column("first"), flat], names=["conv", "block", "first", "matrix"])


def _chain_back(table: pa.Table) -> pa.Table:
    """The cost to the conversation's end at every block's right edge."""
    table = table.sort_by([("block", "descending")])
    right, out = _END, []
    for matrix in table.column("matrix").to_pylist():
        out.append(right)
        right = np.minimum((np.array(matrix).reshape(STATES, STATES) + right).min(axis=1), FAR)
    return pa.table({"first": table.column("first"), "right": pa.array(list(out), pa.list_(pa.int64()))})


def _chain_forth(table: pa.Table) -> pa.Table:
    """The state in which every block is entered, and whether its first turn follows the last one illegally."""
    table = table.sort_by("block")
    state, before, entry, illegal = START, None, [], []
    for leaves, head, tail in zip(*(table.column(name).to_pylist() for name in ("leaves", "head", "tail"))):
        entry.append(state)
        illegal.append(int(before is not None and not _LEGAL[before & 3, head & 3]))
        state, before = leaves[state], tail
    return pa.table({"first": table.column("first"), "entry": pa.array(entry, pa.int32()), "edge": pa.array(illegal, pa.int64())})


_LEGAL = np.zeros((4, 4), bool)
_LEGAL[1, 2] = _LEGAL[2, 3] = _LEGAL[3, 2] = True


def _solve(batch: pa.RecordBatch, codes: list[np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, Arcs, np.ndarray, int]:
    """Costs of places, arcs, and paths from the ``starts`` states (block, k) of every block."""
    grid = _grid(codes)
    right = np.array(batch.column("right").to_pylist())
    cost = place_costs(grid, right[..., None])[..., 0]
    arcs = ranked_arcs(grid, cost)
    width = grid.shape[1]
    begin = width - np.array([len(c) for c in codes])
    nodes = (np.arange(len(codes))[:, None] * (width + 1) + begin[:, None]) * STATES + starts
    return cost, arcs, arcs.paths(nodes.ravel()).reshape(*nodes.shape, -1), width


def _last_state(arcs: Arcs, path: np.ndarray) -> int:
    """The state that a path (of one arc at least) ends in."""
    steps = path[arcs.letter[path] >= 0]
    return int(arcs.target[steps[-1]] % STATES)


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which the least path leaves a block, for each state it may be entered in."""
    every = np.arange(STATES)[None]
    for batch in batches:
        for some, codes in _alike(batch):
            _, arcs, paths, _ = _solve(some, codes, np.repeat(every, len(codes), axis=0))
            leaves = [[_last_state(arcs, path) for path in rows] for rows in paths]
            yield pa.RecordBatch.from_arrays(
                [some.column("conv"), some.column("block"), some.column("first"), pa.array(leaves, pa.list_(pa.int32())),
                 pa.array([int(c[0]) for c in codes], pa.int32()), pa.array([int(c[-1]) for c in codes], pa.int32())],
                names=["conv", "block", "first", "leaves", "head", "tail"],
            )


def _edits(letters: np.ndarray, states: np.ndarray) -> tuple[list[str], list[str | None], list[list[str]], list[str]]:
    """Per turn: letter, role given by Rerole, roles inserted before it; and roles inserted after the last."""
    ops, given, before, waiting = [], [], [], []
    for letter, state in zip(letters, states):
        if letter == 1:
            waiting.append(ROLES[state])
            continue
        ops.append(LETTERS[letter])
        given.append(str(ROLES[state]) if letter == 3 else None)
        before.append(waiting)
        waiting = []
    return ops, given, before, waiting


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some, codes in _alike(batch):
            entry = np.array(some.column("entry").to_pylist())
            cost, arcs, paths, width = _solve(some, codes, entry[:, None])
            rows: dict[str, list] = {name: [] for name in ("audit", "ops", "given", "before", "after", "cost", "illegal")}
            closing = np.array(some.column("block")) == np.array(some.column("blocks")) - 1
            for row, (path, code) in enumerate(zip(paths[:, 0], codes)):
                steps = path[arcs.letter[path] >= 0]
                letters = arcs.letter[steps]
                states = np.concatenate([[entry[row]], arcs.target[steps] % STATES])
                ops, given, before, after = _edits(letters, states[:-1])
                audit = "".join(LETTERS[k] for k in letters)
                state = int(states[-1])
                while closing[row] and state in (SYSTEM, USER):
                    after.append(ROLES[state])
                    audit, state = audit + "I", int(_GIVEN[state])
                legal = _LEGAL[code[:-1] & 3, code[1:] & 3]
                values = (audit, ops, given, before, after, int(cost[row, width - len(code), entry[row]]), int(len(legal) - legal.sum()))
                for name, value in zip(rows, values):
                    rows[name].append(value)
            kinds = (pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.list_(pa.string())), pa.list_(pa.string()), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [some.column("conv"), some.column("block"), some.column("seqs"), some.column("edge"), *(pa.array(rows[n], k) for n, k in zip(rows, kinds))],
                names=["conv", "block", "seqs", "edge", *rows],
            )


_SOLVED = (
    "conv string, block long, seqs array<long>, edge long, audit string, ops array<string>, given array<string>, "
    "before array<array<string>>, after array<string>, cost long, illegal long"
)


def _solved(blocks: DataFrame) -> DataFrame:
    """Every block with its part of the audit and the edits of its turns."""
    ends = F.array(*[F.lit(int(x)).cast("long") for x in _END])
    whole = blocks.filter("blocks = 1").withColumns({"right": ends, "entry": F.lit(0), "edge": F.lit(0).cast("long")})
    parts = blocks.filter("blocks > 1")
    costs = parts.select("conv", "block", "first", "codes").mapInArrow(tidy(_matrices), "conv string, block long, first long, matrix array<long>")
    right = stored(costs.groupBy("conv").applyInArrow(_chain_back, "first long, right array<long>"))
    priced = parts.join(right, "first")
    leaves = priced.select("conv", "block", "first", "codes", "right").mapInArrow(
        tidy(_leaves), "conv string, block long, first long, leaves array<int>, head int, tail int"
    )
    entered = leaves.groupBy("conv").applyInArrow(_chain_forth, "first long, entry int, edge long")
    return whole.unionByName(priced.join(entered, "first")).mapInArrow(tidy(_repairs), _SOLVED)


@dataclass
class Repair:
    """Stored tables of one repair: turns, their faults, and the solved blocks."""

    turns: DataFrame
    faulty: DataFrame
    solved: DataFrame

    def rows(self) -> DataFrame:
        """conv, conv_id, block, at, step, role and text of every turn of the repaired conversations, to be ordered by block, at and step."""
        turn = F.explode(F.arrays_zip("seqs", "ops", "given", "before", F.sequence(F.lit(0), F.size("seqs") - 1).alias("at")))
        each = self.solved.select("conv", "block", turn.alias("e")).select("conv", "block", "e.seqs", "e.ops", "e.given", "e.before", "e.at")
        stay = each.filter("ops <> 'D'").select(F.col("seqs").alias("seq"), "block", "at", "given")
        own = self.turns.join(stay, "seq").select(
            "conv", "block", "at", F.lit(1 << 30).alias("step"), F.coalesce("given", "role").alias("role"), "text"
        )
        inner = each.filter(F.size("before") > 0).select("conv", "block", "at", F.posexplode("before").alias("step", "role"))
        last = self.solved.select("conv", "block", F.size("seqs").alias("at"), F.posexplode("after").alias("step", "role"))
        return own.unionByName(inner.unionByName(last).withColumn("text", F.lit("")))


def repair(turns: DataFrame, block: int = BLOCK) -> Repair:
    """The cheapest repair of ``turns`` (conv_id, turn, role, text)."""
    numbered = stored(_numbered(in_small_batches(turns)))
    faulty = stored(with_faults(numbered))
    return Repair(numbered, faulty, stored(_solved(_blocks(faulty, block))))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines; rows come in order, so one hash is open at a time."""
    name, state = None, None
    made = lambda: pa.RecordBatch.from_arrays([pa.array([name]), pa.array([state.hexdigest()])], names=["conv", "sha"])
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text"))):
            if conv != name:
                if state is not None:
                    yield made()
                name, state = conv, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
    if state is not None:
        yield made()


def report(turns: DataFrame, conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per conv_id of ``conversations``: faults, gaps, illegal neighbours, cost, audit and digest of the repaired turns.

    A conversation of which ``turns`` holds none has zeros, an empty audit and the digest of nothing.
    """
    done = repair(turns, block)
    key = F.when(F.col("conv_id").isNull(), "null").otherwise(F.concat(F.lit("id "), F.col("conv_id").cast("string")))
    number = lambda fault: F.count(F.when(F.col("fault") == fault, 1)).alias(fault)
    faults = ("blank", "duplicate", "truncated")
    by_turn = done.faulty.groupBy("conv", "turn").agg(*map(number, faults))
    counts = by_turn.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"), *[F.sum(f).alias(f) for f in faults]
    )
    structure = done.solved.groupBy("conv").agg(
        (F.sum("illegal") + F.sum("edge")).alias("illegal"), F.sum(F.when(F.col("block") == 0, F.col("cost"))).alias("cost"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    ordered = done.rows().repartition("conv").sortWithinPartitions("conv", "block", "at", "step").select("conv", "role", "text")
    digests = ordered.mapInArrow(tidy(_digests), "conv string, sha string")
    asked = conversations.select("conv_id").distinct().withColumn("conv", key)
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return asked.join(counts, "conv", "left").join(structure, "conv", "left").join(digests, "conv", "left").select(
        "conv_id", *map(zero, ("gaps", *faults, "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
