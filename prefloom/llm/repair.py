"""Repair of the structure of conversations by cheapest edits, the least of them in ASCII order of their audit.

Faults: a row is blank (no sign but white space), else a duplicate (its role and text stood earlier in the conversation), else truncated (its last
sign but white space ends no sentence). Edits: Keep (0), Rerole to user or assistant (2), Delete (3; must be done to blank rows and duplicates),
Insert an empty user or assistant row anywhere (2); a truncated row that stays adds 1. Roles must then read, by initials, ``(s?(ua)+)?``.

A path goes over nodes (row, state); the states are: nothing yet, behind s, behind u, behind a. Its labels, the initials of the edits, are the audit.

* Cost DP: each row is a 4 x 4 matrix of least costs between states, inserts before it included; the costs to the end from every row are
  suffix products of these matrices (least sums), found by doubling.
* Path ranking: an arc is optimal if its cost and the cost behind it add up to the cost of its node. Each node points along its optimal arc
  with the least initial. (The role of a rerole or insert follows from the state, so the initials of a node's arcs differ.) Nodes are ranked by the first
  1, 2, 4, ... signs of their least audits, each round pairing the rank of a node with that of the node its doubled pointer leads to. Nodes
  of equal final rank have equal audits, so each audit is spelled out once: sign j is that of the node which the doubled pointers for the bits of j lead to.

On Spark: rows are range-partitioned by (conversation, turn, hash of the row, stored row number), so a task sees conversations in order and a huge one is cut.
Conversations that lie within one task are done there, many at a time. The first and last one of a task and huge ones leave as segments of
bounded size: their matrices are multiplied per conversation (one small row for each segment), so each segment learns the costs behind its end, finds the
exit and audit for each state it may be entered in, and the states are composed per conversation. Only the digest streams all segments of a conversation
through one task, in order and one at a time, as a digest is one sequence.

Cases: null roles and texts are one space; null turns stand first; rows of one turn follow the MD5 of ``role:text``; a null conversation id is a conversation of its
own; conversations all of whose rows are marked as gone have a row of zeros; an empty table gives an empty result; further columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.llm.common import map_batches
from prefloom.session import keep

SPACE = " \t\n\x0b\x0c\r"
INSERT_COST, REROLE_COST, DELETE_COST, TRUNCATED_COST = 2, 2, 3, 1
FAR = np.int64(1) << 40
#: states: nothing yet, behind s, behind u, behind a; and the state and role that an insert or a rerole leads to from each
NEXT = np.array([2, 2, 3, 2])
ROLE = ("user", "user", "assistant", "user")
#: state behind a kept row by its initial (s, u, a, other) and the state before, -1 where it may not stand
KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
#: costs to the end behind the last row, inserts included
END = np.array([0, 2 * INSERT_COST, INSERT_COST, 0], dtype=np.int64)
LABELS = " DIKR"


@dataclass(frozen=True)
class Limits:
    """Rows and bytes of a segment, and rows of conversations that are solved at a time."""

    rows: int = 16_384
    bytes: int = 8 << 20
    together: int = 16_384


def _steps() -> np.ndarray:
    """Costs between states over one row by its kind: 4 * initial + 2 * must go + truncated."""
    inserts = np.full((4, 4), FAR)
    for s in range(4):
        at = s
        for n in range(3):
            inserts[s, at] = min(inserts[s, at], n * INSERT_COST)
            at = NEXT[at]
    kinds = []
    for kind in range(16):
        initial, must, cut = kind // 4, kind // 2 % 2, kind % 2
        act = np.full((4, 4), FAR)
        for s in range(4):
            act[s, s] = DELETE_COST
            if not must:
                act[s, NEXT[s]] = REROLE_COST + cut * TRUNCATED_COST
                if KEPT[initial, s] >= 0:
                    act[s, KEPT[initial, s]] = cut * TRUNCATED_COST
        kinds.append(over(inserts[None], act[None])[0])
    return np.array(kinds)


def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least sums of two stacks of matrices."""
    return np.minimum((a[:, :, :, None] + b[:, None, :, :]).min(2), FAR)


def suffix_products(m: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Product of each matrix with all behind it in its group; ``size`` has the group sizes."""
    end = np.repeat(np.cumsum(size), size)
    at, hop = np.arange(len(m)), 1
    m = m.copy()
    while True:
        far = np.flatnonzero(at + hop < end)
        if not len(far):
            return m
        m[far] = over(m[far], m[far + hop])
        hop *= 2


STEPS = _steps()


@dataclass
class Paths:
    """Least audits from nodes ``4 * level + state``; group g has the levels from ``base[g]`` on, one more than rows."""

    base: np.ndarray
    label: np.ndarray
    rank: np.ndarray
    jumps: list[np.ndarray]
    length: np.ndarray

    def audits(self, nodes: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Audits of the nodes and the nodes that their paths end in."""
        _, first, which = np.unique(self.rank[nodes], return_index=True, return_inverse=True)
        starts = nodes[first]
        size = self.length[starts]
        at = np.repeat(starts, size)
        sign = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        for k, jump in enumerate(self.jumps):
            on = (sign >> k & 1).astype(bool)
            at[on] = jump[at[on]]
        text = np.frombuffer(LABELS.encode(), np.uint8)[self.label[at]].tobytes().decode()
        cuts = np.concatenate(([0], np.cumsum(size)))
        spelled = [text[cuts[k] : cuts[k + 1]] for k in range(len(starts))]
        return [spelled[k] for k in which], self.jumps[-1][nodes]


def solve(kinds: np.ndarray, size: np.ndarray, after: np.ndarray, final: np.ndarray) -> Paths:
    """Least paths over groups of rows: ``after`` has the costs behind each group's end by state; a group that is not ``final`` ends in
    any state, a final one where a conversation may."""
    groups = len(size)
    base = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    level = np.arange(len(kinds)) + np.repeat(np.arange(groups), size)
    costs = np.zeros((len(kinds) + groups, 4), np.int64)
    costs[base + size] = after
    if len(kinds):
        costs[level] = (suffix_products(STEPS[kinds], size) + np.repeat(after, size, axis=0)[:, None, :]).min(2)
    label = np.zeros(costs.shape, np.int64)
    target = np.arange(costs.size).reshape(costs.shape)
    here, ahead = costs[level], costs[level + 1]
    must, cut, initial = kinds // 2 % 2 == 1, kinds % 2 * TRUNCATED_COST, kinds // 4
    state = np.arange(4)[None, :]
    kept = KEPT[initial]
    # from the largest initial to the least, so that the least stays
    free = ~must[:, None]
    row_label, row_target = np.zeros(here.shape, np.int64), np.zeros(here.shape, np.int64)
    for number, fine, to in (
        (4, free & (here == REROLE_COST + cut[:, None] + ahead[:, NEXT]), 4 * (level[:, None] + 1) + NEXT[None, :]),
        (3, free & (kept >= 0) & (here == cut[:, None] + np.take_along_axis(ahead, np.maximum(kept, 0), 1)), 4 * (level[:, None] + 1) + kept),
        (2, here == INSERT_COST + here[:, NEXT], 4 * level[:, None] + NEXT[None, :]),
        (1, here == DELETE_COST + ahead, 4 * (level[:, None] + 1) + state),
    ):
        row_label, row_target = np.where(fine, number, row_label), np.where(fine, to, row_target)
    label[level], target[level] = row_label, row_target
    last = (base + size)[final]
    for s in (1, 2):
        label[last, s], target[last, s] = 2, 4 * last + NEXT[s]
    label, pointer = label.reshape(-1), target.reshape(-1)
    rank, length, jumps = label, (label > 0).astype(np.int64), [pointer]
    while len(pointer):
        rank = np.unique(rank * (rank.max() + 1) + rank[pointer], return_inverse=True)[1]
        length = length + length[pointer]
        pointer = pointer[pointer]
        jumps.append(pointer)
        if not label[pointer].any():
            break
    return Paths(base, label, rank, jumps, length)


def row_kinds(roles: list[str], texts: list[str], seen: set) -> tuple[np.ndarray, list[int]]:
    """Kind of each row, and how many are blank, duplicates, truncated. ``seen`` has the marks of rows that stood earlier, and gets those of these."""
    kinds, counts = np.zeros(len(roles), np.int64), [0, 0, 0]
    for k, (role, text) in enumerate(zip(roles, texts, strict=True)):
        bare = text.rstrip(SPACE)
        mark = row_mark(role, text)
        fault = 1 if not bare else 2 if mark in seen else 0 if bare[-1] in ".!?" else 3
        seen.add(mark)
        if fault:
            counts[fault - 1] += 1
        kinds[k] = 4 * {"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + 2 * (fault in (1, 2)) + (fault == 3)
    return kinds, counts


def row_mark(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def apply(audit: str, roles: list[str], texts: list[str], kinds: np.ndarray, state: int = 0) -> tuple[list[tuple[str, str]], int]:
    """Rows behind the edits, and what these cost."""
    out, cost, k = [], 0, 0
    for edit in audit:
        if edit == "I":
            out.append((ROLE[state], ""))
            cost, state = cost + INSERT_COST, int(NEXT[state])
            continue
        if edit == "D":
            cost += DELETE_COST
        else:
            cost += (kinds[k] % 2) * TRUNCATED_COST + (REROLE_COST if edit == "R" else 0)
            out.append((roles[k], texts[k]) if edit == "K" else (ROLE[state], texts[k]))
            state = int(KEPT[kinds[k] // 4, state] if edit == "K" else NEXT[state])
        k += 1
    return out, int(cost)


def illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def digest_of(rows: Iterable[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode("utf-8", "surrogatepass")).hexdigest()


def turn_gaps(turns: list[int | None]) -> int:
    known = [t for t in turns if t is not None]
    return max(known) - min(known) + 1 - len(set(known)) if known else 0


FOUND = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
SEGMENT = "seg bigint, turns array<bigint>, roles array<string>, texts array<string>"
RESULT = ", ".join(f"{c} bigint" for c in FOUND) + ", audit string, repaired_sha256 string"
_STRINGS = pa.list_(pa.string())


def solved(talks: list[tuple]) -> Iterator[tuple]:
    """Results of whole conversations (id, turns, roles, texts), with their repaired rows."""
    made = [row_kinds(r, t, set()) for _, _, r, t in talks]
    size = np.array([len(r) for _, _, r, _ in talks], dtype=np.int64)
    kinds = np.concatenate([k for k, _ in made])
    paths = solve(kinds, size, np.repeat(END[None], len(talks), axis=0), np.ones(len(talks), bool))
    audits, _ = paths.audits(4 * paths.base)
    for (talk, turns, roles, texts), (k, counts), audit in zip(talks, made, audits, strict=True):
        rows, cost = apply(audit, roles, texts, k)
        yield talk, turn_gaps(turns), *counts, illegal([r[:1] for r in roles]), cost, audit, rows


def damage(df: DataFrame, talk: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``talk, turn, role, text, gone``: rows hurt by the remainder of the crc32 of ``talk:turn`` by 20. 0: gone, 1: its text is emptied, 2: its
    sentence ends are removed, 3: it stands twice, 4: its role is user."""
    either = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(either(talk), F.lit(":"), either(turn)).cast("binary")) % 20
    rows = df.select(F.col(talk).alias("talk"), F.col(turn).cast("bigint").alias("turn"), either(role).alias("role"), either(text).alias("text"), code.alias("code"))
    hurt = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("code") == 3, 2).otherwise(1)))
    return rows.select("talk", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), hurt.alias("text"), (F.col("code") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def rows_of(df: DataFrame, talk: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None) -> DataFrame:
    """The columns that the other functions read, from conversations as they are."""
    either = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    there = F.lit(False) if gone is None else gone
    return df.select(F.col(talk).alias("talk"), F.col(turn).cast("bigint").alias("turn"), either(role).alias("role"), either(text).alias("text"), there.alias("gone"))


def walk(rows: DataFrame, limits: Limits = Limits(), repaired: bool = False) -> DataFrame:
    """Rows in order; conversations within a task are solved, the others leave as segments. One stored table with ``open``, telling which."""
    kind = rows.schema["talk"].dataType.simpleString()
    order = ["talk", "turn", F.md5(F.concat("role", F.lit(":"), "text").cast("binary")).alias("tie"), F.monotonically_increasing_id().alias("row")]
    cut = rows.select(*order, "role", "text", "gone").repartitionByRange("talk", "turn", "tie", "row").sortWithinPartitions("talk", "turn", "tie", "row")
    names = ["talk", "open", "seg", "turns", "roles", "texts", *FOUND, "audit", "repaired_sha256", "repaired"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        segment = TaskContext.get().partitionId() << 32
        talk_type = pa.int64()
        now, held, size, is_open, started = None, ([], [], []), 0, True, False
        whole: list[tuple] = []
        waiting = 0

        def out(made: list[tuple]) -> pa.RecordBatch:
            kinds = [talk_type, pa.bool_(), pa.int64(), pa.list_(pa.int64()), _STRINGS, _STRINGS, *[pa.int64()] * 6, pa.string(), pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names=names)

        def leave() -> pa.RecordBatch:
            nonlocal held, size, segment
            gone = out([(now, True, segment, *held, *[None] * 9)])
            segment += 1
            held, size = ([], [], []), 0
            return gone

        def finish() -> pa.RecordBatch:
            nonlocal whole, waiting
            made = []
            for name, *found, audit, rows_ in solved(whole):
                listed = [{"role": r, "text": t} for r, t in rows_] if repaired else None
                made.append((name, False, None, None, None, None, *found, audit, digest_of(rows_), listed))
            whole, waiting = [], 0
            return out(made)

        for batch in batches:
            talk_type = batch.schema.field("talk").type
            columns = [batch.column(c).to_pylist() for c in ("talk", "turn", "role", "text", "gone")]
            for talk, turn, role, text, gone in zip(*columns, strict=True):
                if not started or talk != now:
                    if started:
                        if is_open:
                            yield leave()
                        else:
                            whole.append((now, *held))
                            waiting += len(held[0]) + 1
                            held, size = ([], [], []), 0
                            if waiting >= limits.together:
                                yield finish()
                        is_open = False
                    now, started = talk, True
                if gone:
                    continue
                if len(held[0]) >= limits.rows or (size and size + len(text) > limits.bytes):
                    is_open = True
                    yield leave()
                for part, value in zip(held, (turn, role, text), strict=True):
                    part.append(value)
                size += len(text) + len(role)
        if whole:
            yield finish()
        if started:
            yield leave()

    listed = "repaired array<struct<role: string, text: string>>"
    return keep(cut.mapInArrow(run, f"talk {kind}, open boolean, {SEGMENT}, {RESULT}, {listed}"), "walked")


def _key() -> Column:
    """Null ids are equal in a struct."""
    return F.struct("talk").alias("key")


def measure_segments(segments: DataFrame) -> DataFrame:
    """``seg, talk, kinds, m`` and the counts of each segment, duplicates of earlier segments found by their marks."""
    def marks(batch: pa.RecordBatch) -> pa.RecordBatch:
        seg, mark = [], []
        for s, roles, texts in zip(*(batch.column(c).to_pylist() for c in ("seg", "roles", "texts")), strict=True):
            own = {row_mark(r, t) for r, t in zip(roles, texts, strict=True)}
            seg += [s] * len(own)
            mark += own
        return pa.RecordBatch.from_arrays([pa.array(seg, pa.int64()), pa.array(mark, pa.binary())], names=["seg", "mark"])

    marked = map_batches(segments.select("seg", "roles", "texts"), marks, "seg bigint, mark binary")
    marked = keep(marked.join(segments.select("seg", _key()), "seg"), "marks")
    first = marked.groupBy("key", "mark").agg(F.min("seg").alias("first"))
    earlier = marked.join(first, ["key", "mark"]).filter("seg > first").groupBy("seg").agg(F.collect_list("mark").alias("earlier"))
    kind = segments.schema["talk"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = []
        columns = (batch.column(c).to_pylist() for c in ("seg", "turns", "roles", "texts", "earlier"))
        for seg, turns, roles, texts, before in zip(*columns, strict=True):
            kinds, counts = row_kinds(roles, texts, set(before or ()))
            m = suffix_products(STEPS[kinds], np.array([len(kinds)]))[0] if len(kinds) else np.where(np.eye(4, dtype=bool), 0, FAR)
            known = [t for t in turns if t is not None]
            ends = (min(known), max(known)) if known else (None, None)
            initials = [r[:1] for r in roles]
            edges = (initials[0], initials[-1]) if initials else (None, None)
            made.append((seg, kinds.tolist(), m.reshape(-1).tolist(), *counts, illegal(initials), *ends, len(set(known)), *edges))
        longs, strings = [pa.int64()] * 7, [pa.string()] * 2
        kinds_ = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *longs, *strings]
        arrays = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds_, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("talk"), *arrays], names=["talk", "seg", "kinds", "m", "blank", "duplicate", "truncated", "illegal", "low", "high", "turns", "head", "tail"])

    joined = segments.select("talk", "seg", "turns", "roles", "texts").join(earlier, "seg", "left")
    schema = f"talk {kind}, seg bigint, kinds array<bigint>, m array<bigint>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, low bigint, high bigint, turns bigint, head string, tail string"
    return keep(map_batches(joined, work, schema), "measured")


def costs_behind(measured: DataFrame) -> DataFrame:
    """``seg, after, final``: costs to the end of the conversation behind each segment, by state."""

    def work(part: pa.Table) -> pa.Table:
        part = part.sort_by("seg")
        m = np.array(part.column("m").to_pylist(), np.int64).reshape(-1, 4, 4)
        n = len(m)
        behind = (suffix_products(m, np.array([n])) + END[None, None, :]).min(2)
        after = np.concatenate([behind[1:], END[None]])
        return pa.table({"seg": part.column("seg"), "after": pa.array(after.tolist(), pa.list_(pa.int64())), "final": pa.array(np.arange(n) == n - 1)})

    return measured.select("talk", "seg", "m").groupBy("talk").applyInArrow(work, "seg bigint, after array<bigint>, final boolean")


def ways_through(measured: DataFrame) -> DataFrame:
    """``talk, seg, exits, audits``: exit state and audit of each segment for every state it may be entered in."""
    kind = measured.schema["talk"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        exits, audits = [], []
        for kinds, after, final in zip(*(batch.column(c).to_pylist() for c in ("kinds", "after", "final")), strict=True):
            paths = solve(np.array(kinds, np.int64), np.array([len(kinds)]), np.array([after], np.int64), np.array([final]))
            spelled, ends = paths.audits(np.arange(4))
            exits.append((ends % 4).tolist())
            audits.append(spelled)
        return pa.RecordBatch.from_arrays([batch.column("talk"), batch.column("seg"), pa.array(exits, pa.list_(pa.int64())), pa.array(audits, _STRINGS)], names=["talk", "seg", "exits", "audits"])

    rows = measured.select("talk", "seg", "kinds").join(costs_behind(measured), "seg")
    return keep(map_batches(rows.select("talk", "seg", "kinds", "after", "final"), work, f"talk {kind}, seg bigint, exits array<bigint>, audits array<string>"), "ways")


def entry_states(ways: DataFrame) -> DataFrame:
    """``seg, state``: the state in which the least path of the whole conversation enters each segment."""

    def work(part: pa.Table) -> pa.Table:
        part = part.sort_by("seg")
        state, states = 0, []
        for exits in part.column("exits").to_pylist():
            states.append(state)
            state = exits[state]
        return pa.table({"seg": part.column("seg"), "state": pa.array(states, pa.int64())})

    return ways.select("talk", "seg", "exits").groupBy("talk").applyInArrow(work, "seg bigint, state bigint")


def repaired_segments(segments: DataFrame, measured: DataFrame) -> DataFrame:
    """``measured`` without its matrices, with ``audit``, ``cost`` and the repaired rows of each segment."""
    ways = ways_through(measured)
    chosen = ways.join(entry_states(ways), "seg").select("seg", "state", F.expr("audits[cast(state as int)]").alias("audit"))
    rows = segments.select("seg", "roles", "texts").join(measured.drop("m"), "seg").join(chosen, "seg")
    plain = [c for c in measured.columns if c not in ("m", "kinds")]
    schema = ", ".join(f"{c} {measured.schema[c].dataType.simpleString()}" for c in plain)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made, costs = [], []
        for audit, roles, texts, kinds, state in zip(*(batch.column(c).to_pylist() for c in ("audit", "roles", "texts", "kinds", "state")), strict=True):
            out, cost = apply(audit, roles, texts, np.array(kinds, np.int64), state)
            made.append([{"role": r, "text": t} for r, t in out])
            costs.append(cost)
        listed = pa.array(made, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in plain), batch.column("audit"), pa.array(costs, pa.int64()), listed], names=[*plain, "audit", "cost", "repaired"])

    return map_batches(rows, work, f"{schema}, audit string, cost bigint, repaired array<struct<role: string, text: string>>")


def streamed(parts: DataFrame) -> DataFrame:
    """One row per conversation from its segments, which pass one after the other."""
    kind = parts.schema["talk"].dataType.simpleString()
    names = ["talk", *FOUND, "audit", "repaired_sha256"]
    summed = ["blank", "duplicate", "truncated", "illegal", "cost"]
    fields = [*summed, "low", "high", "turns", "head", "tail", "audit", "repaired"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, started = None, False
        total: dict = {}

        def result(talk_type: pa.DataType) -> pa.RecordBatch:
            gaps = total["high"] - total["low"] + 1 - total["turns"] if total["high"] is not None else 0
            row = (now, gaps, *(total[c] for c in summed), "".join(total["audits"]), total["hash"].hexdigest())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [talk_type, *[pa.int64()] * 6, pa.string(), pa.string()], strict=True)], names=names)

        talk_type = None
        for batch in batches:
            talk_type = batch.schema.field("talk").type
            for at in range(batch.num_rows):
                talk = batch.column("talk")[at].as_py()
                part = {c: batch.column(c)[at].as_py() for c in fields}
                if not started or talk != now:
                    if started:
                        yield result(talk_type)
                    now, started = talk, True
                    total = dict.fromkeys(summed, 0) | {"low": None, "high": None, "turns": 0, "tail": None, "audits": [], "hash": hashlib.sha256(), "any": False}
                for c in summed:
                    total[c] += part[c]
                if part["head"] is not None:
                    total["illegal"] += illegal([total["tail"], part["head"]]) if total["tail"] is not None else 0
                    total["tail"] = part["tail"]
                if part["low"] is not None:
                    total["turns"] += part["turns"] - (part["low"] == total["high"])
                    total["low"] = part["low"] if total["low"] is None else total["low"]
                    total["high"] = part["high"]
                total["audits"].append(part["audit"])
                for row in part["repaired"]:
                    line = f"{row['role']}:{row['text']}"
                    total["hash"].update((f"\n{line}" if total["any"] else line).encode("utf-8", "surrogatepass"))
                    total["any"] = True
        if started:
            yield result(talk_type)

    ordered = parts.select("talk", "seg", *fields).repartition("talk").sortWithinPartitions("talk", "seg")
    return ordered.mapInArrow(run, f"talk {kind}, {RESULT}")


def repair(rows: DataFrame, name: str = "conv_id", limits: Limits = Limits()) -> DataFrame:
    """One row per conversation of ``rows`` (:func:`rows_of` or :func:`damage`): its id as ``name``, counts of faults, cost, audit and digest."""
    walked = walk(rows, limits)
    segments = walked.filter("open").select("talk", "seg", "turns", "roles", "texts")
    rest = streamed(repaired_segments(segments, measure_segments(segments)))
    every = walked.filter("not open").select("talk", *FOUND, "audit", "repaired_sha256").union(rest)
    return every.select(F.col("talk").alias(name), *FOUND, "audit", "repaired_sha256")


def repaired(rows: DataFrame, name: str = "conv_id", limits: Limits = Limits()) -> DataFrame:
    """The rows of the repaired conversations: id as ``name``, ``part`` and ``place`` (their order), ``role``, ``text``."""
    walked = walk(rows, limits, repaired=True)
    segments = walked.filter("open").select("talk", "seg", "turns", "roles", "texts")
    rest = repaired_segments(segments, measure_segments(segments)).select("talk", "seg", "repaired")
    every = walked.filter("not open").select("talk", F.lit(0).cast("bigint").alias("seg"), "repaired").union(rest)
    return every.select(F.col("talk").alias(name), F.col("seg").alias("part"), F.posexplode("repaired").alias("place", "r")).select(name, "part", "place", "r.role", "r.text")


#: the same in SQL, a recursion from the last row of each conversation to its first
TWIN = """
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS k FROM conversations
), coded AS (
  SELECT *, xor(list_reduce(list_transform(range(1, length(k), 2), lambda i: CAST('0x' || substr(k, CAST(i AS INTEGER), 2) AS BIGINT)),
    lambda c, b: list_reduce(range(8), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295), 4294967295) % 20 AS code FROM raw
), hurt AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy FROM coded WHERE code <> 0
), talks AS (
  SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM conversations)
), ranked AS (
  SELECT g, turn, role, text, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, md5(role || ':' || text), copy) AS i
  FROM hurt JOIN talks ON hurt.conv_id IS NOT DISTINCT FROM talks.conv_id
), bare AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS b, row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again,
    lag(left(role, 1)) OVER (PARTITION BY g ORDER BY i) || left(role, 1) AS pair FROM ranked
), rows_ AS (
  SELECT *, left(role, 1) AS r, CASE WHEN b = '' THEN 1 WHEN again THEN 2 WHEN right(b, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault FROM bare
), counts AS (
  SELECT g, count(*) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY g
), walk(g, i, f0, f1, f2, f3) AS (
  SELECT g, n + 1, {c: 0, a: '', o: ''}, {c: 4, a: 'II', o: chr(10) || 'user:' || chr(10) || 'assistant:'}, {c: 2, a: 'I', o: chr(10) || 'assistant:'}, {c: 0, a: '', o: ''} FROM counts
  UNION ALL
  SELECT g, i,
    list_sort([b0, {c: b2.c + 2, a: 'I' || b2.a, o: chr(10) || 'user:' || b2.o}, {c: b3.c + 4, a: 'II' || b3.a, o: chr(10) || 'user:' || chr(10) || 'assistant:' || b3.o}])[1],
    list_sort([b1, {c: b2.c + 2, a: 'I' || b2.a, o: chr(10) || 'user:' || b2.o}, {c: b3.c + 4, a: 'II' || b3.a, o: chr(10) || 'user:' || chr(10) || 'assistant:' || b3.o}])[1],
    list_sort([b2, {c: b3.c + 2, a: 'I' || b3.a, o: chr(10) || 'assistant:' || b3.o}])[1],
    list_sort([b3, {c: b2.c + 2, a: 'I' || b2.a, o: chr(10) || 'user:' || b2.o}])[1]
  FROM (
    SELECT w.g, x.i,
      list_sort([{c: f0.c + 3, a: 'D' || f0.a, o: f0.o}, {c: f2.c + t + 2 + m, a: 'R' || f2.a, o: chr(10) || 'user:' || text || f2.o},
        {c: (CASE r WHEN 's' THEN f1.c WHEN 'u' THEN f2.c ELSE 99999999 END) + t + m, a: 'K' || (CASE r WHEN 's' THEN f1.a ELSE f2.a END), o: line || (CASE r WHEN 's' THEN f1.o ELSE f2.o END)}])[1] AS b0,
      list_sort([{c: f1.c + 3, a: 'D' || f1.a, o: f1.o}, {c: f2.c + t + 2 + m, a: 'R' || f2.a, o: chr(10) || 'user:' || text || f2.o},
        {c: (CASE r WHEN 'u' THEN f2.c ELSE 99999999 END) + t + m, a: 'K' || f2.a, o: line || f2.o}])[1] AS b1,
      list_sort([{c: f2.c + 3, a: 'D' || f2.a, o: f2.o}, {c: f3.c + t + 2 + m, a: 'R' || f3.a, o: chr(10) || 'assistant:' || text || f3.o},
        {c: (CASE r WHEN 'a' THEN f3.c ELSE 99999999 END) + t + m, a: 'K' || f3.a, o: line || f3.o}])[1] AS b2,
      list_sort([{c: f3.c + 3, a: 'D' || f3.a, o: f3.o}, {c: f2.c + t + 2 + m, a: 'R' || f2.a, o: chr(10) || 'user:' || text || f2.o},
        {c: (CASE r WHEN 'u' THEN f2.c ELSE 99999999 END) + t + m, a: 'K' || f2.a, o: line || f2.o}])[1] AS b3
    FROM walk w JOIN (
      SELECT *, chr(10) || role || ':' || text AS line, CASE WHEN fault = 3 THEN 1 ELSE 0 END AS t, CASE WHEN fault IN (1, 2) THEN 99999999 ELSE 0 END AS m FROM rows_
    ) x ON x.g = w.g AND x.i = w.i - 1
  )
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(f0.c, 0) AS BIGINT) AS cost, coalesce(f0.a, '') AS audit, sha256(coalesce(substr(f0.o, 2), '')) AS repaired_sha256
FROM talks LEFT JOIN counts USING (g) LEFT JOIN (SELECT g, f0 FROM walk WHERE i = 1) USING (g)
"""
