"""Conversation structure repair by a minimum-cost walk through a role grammar.

Role initials of a well-formed conversation are ``(s?(ua)+)?``. Rows are marked
with their faults by window functions; then a DuckDB recursive query inside
hash-partitioned batches walks all conversations of a batch together: each
recursion advances one turn and keeps, for each grammar state, the least cost
and the ASCII-least audit of that cost.

How long conversations are bounded: a conversation is cut into pieces of
``SPAN`` turns. A later piece is walked from every state that it may be entered
in, so that all pieces advance at once and no recursion is longer than ``SPAN``;
the pieces' tables (entry state, exit state, cost, audit) are then composed in
order. After a turn's letter, no audit of a state is the beginning of another,
so a comparison of audits is one of (entry's rank, piece's audit). The walk
reads three small columns, never texts: a task holds a few bytes a turn of one
conversation. Texts stream past the finished audit, sorted, one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.common import slices
from quarryline.session import materialize

REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
SPAN = 64
#: Turns of whole conversations that one recursive query takes together; one longer conversation is taken alone.
BATCH = 16_384
BLANK_CHARS = " \t\n\x0b\f\r"
STOPS = ".!?"

START, SYSTEM, USER, ASSISTANT = range(4)
#: The grammar: the state that a role's initial leads to.
AFTER = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: What an inserted or renamed row becomes in each state.
ROLE = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}


def steps() -> list[tuple[int, str | None, int, int, str]]:
    """``(state, initial, into, cost, letters)`` of one turn: rows inserted before it, then the turn's own edit; initial None fits any.

    Rows inserted before a deleted one are left out: after it they cost the same and ``D`` sorts before ``I``.
    """
    out: list[tuple[int, str | None, int, int, str]] = [(state, None, state, DELETE, "D") for state in AFTER]
    for state in AFTER:
        at = state
        for n in range(3):
            out += [(state, initial, into, INSERT * n, "I" * n + "K") for initial, into in AFTER[at].items()]
            at_next = AFTER[at][ROLE[at][0]]
            out.append((state, None, at_next, INSERT * n + REROLE, "I" * n + "R"))
            at = at_next
    return out


WALK = """
WITH RECURSIVE walk(piece, step, entry, state, cost, audit) AS (
  SELECT piece, 0, entry, entry, 0, '' FROM starts
  UNION ALL
  SELECT piece, step, entry, state, cost, audit FROM (
    SELECT w.piece, w.step + 1 AS step, w.entry, m.into_state AS state, w.cost + m.cost + CASE WHEN m.letters = 'D' THEN 0 ELSE t.toll END AS cost, w.audit || m.letters AS audit
    FROM walk w JOIN turns t ON t.piece = w.piece AND t.step = w.step
    JOIN moves m ON m.state = w.state AND (m.initial IS NULL OR m.initial = t.initial) AND (m.letters = 'D' OR NOT t.goes))
  QUALIFY row_number() OVER (PARTITION BY piece, entry, state ORDER BY cost, audit) = 1)
SELECT piece, entry, state, cost, audit FROM walk JOIN ends USING (piece, step) ORDER BY piece, entry, state
"""


def walked(initial: np.ndarray, goes: np.ndarray, toll: np.ndarray, lengths: np.ndarray) -> list[tuple[int, str]]:
    """``(cost, audit)`` of each of some conversations, whose turns stand one after another."""
    import duckdb

    pieces = -(-lengths // SPAN)
    first = np.cumsum(pieces) - pieces  # number of each conversation's first piece
    within = np.arange(len(initial)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    piece = np.repeat(first, lengths) + within // SPAN
    heads = np.zeros(int(pieces.sum()), bool)
    heads[first[pieces > 0]] = True
    starts = [(p, e) for p, head in enumerate(heads.tolist()) for e in ((START,) if head else AFTER)]
    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
    try:
        con.register("turns", pa.table({"piece": piece.astype(np.int32), "step": (within % SPAN).astype(np.int32), "initial": pa.array(initial, pa.string()), "goes": goes, "toll": toll.astype(np.int32)}))
        con.register("starts", pa.table({"piece": pa.array([p for p, _ in starts], pa.int32()), "entry": pa.array([e for _, e in starts], pa.int32())}))
        con.register("ends", pa.table({"piece": np.arange(len(heads), dtype=np.int32), "step": np.bincount(piece, minlength=len(heads)).astype(np.int32)}))
        columns = list(zip(*steps(), strict=True))
        con.register("moves", pa.table(dict(zip(("state", "initial", "into_state", "cost", "letters"), (pa.array(c) for c in columns), strict=True))))
        rows = con.execute(WALK).fetchall()
    finally:
        con.close()
    tables: list[list[tuple[int, int, int, str]]] = [[] for _ in heads]
    for p, entry, state, cost, audit in rows:
        tables[p].append((entry, state, cost, audit))
    return [compose(tables[f : f + n]) for f, n in zip(first.tolist(), pieces.tolist(), strict=True)]


def compose(pieces: list[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """The cheapest whole walk, and its audit, from the tables of a conversation's pieces in order."""
    now: dict[int, tuple[int, int]] = {START: (0, 0)}  # state: cost, rank of its audit among the states'
    back: list[dict[int, tuple[int, str]]] = []
    for table in pieces:
        best: dict[int, tuple[int, tuple[int, str], int]] = {}
        for entry, state, cost, audit in table:
            if entry in now:
                found = (now[entry][0] + cost, (now[entry][1], audit), entry)
                if state not in best or found < best[state]:
                    best[state] = found
        ranks = {key: i for i, key in enumerate(sorted(x[1] for x in best.values()))}
        back.append({state: (entry, key[1]) for state, (_, key, entry) in best.items()})
        now = {state: (cost, ranks[key]) for state, (cost, key, _) in best.items()}

    def audit(state: int) -> str:
        parts = []
        for table in reversed(back):
            state, part = table[state]
            parts.append(part)
        return "".join(reversed(parts))

    ends = []
    for state, more in ((START, ""), (ASSISTANT, ""), (USER, "I"), (SYSTEM, "II")):
        if state in now:
            ends.append((now[state][0] + INSERT * len(more), state, more))
    least = min(cost for cost, _, _ in ends)
    return least, min(audit(state) + more for cost, state, more in ends if cost == least)


def marked(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text, lives)`` in order, with ``at`` from 1 and each row's first fault.

    ``lives`` false marks a row that only says that its conversation exists: ``at`` is null.
    """
    tail = F.rtrim("text", F.lit(BLANK_CHARS))
    rows = rows.select("*", F.substring("role", 1, 1).alias("initial"), F.right(tail, F.lit(1)).alias("last"))
    order = Window.partitionBy("conv_id", "lives").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.select(
        "*",
        F.when(F.col("lives"), F.row_number().over(order)).alias("at"),
        F.lag("initial").over(order).alias("before"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(order))).alias("new_turn"),
    )
    seen = F.row_number().over(Window.partitionBy("conv_id", "lives", "role", "text").orderBy("at")) > 1
    fault = F.when(F.col("last") == "", "blank").when(seen, "duplicate").when(~F.col("last").isin(*STOPS), "truncated")
    illegal = F.col("before").isNotNull() & ~F.concat("before", "initial").isin("su", "ua", "au")
    return rows.select("conv_id", "turn", "role", "text", "lives", "at", "initial", "new_turn", fault.alias("fault"), illegal.alias("illegal"))


def faults(turns: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal`` of each conversation."""
    count = lambda c: F.count(F.when(F.col("lives") & c, 1))
    turn = F.when(F.col("lives"), F.col("turn"))
    return turns.groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - count(F.col("new_turn")), F.lit(0)).alias("gaps"),
        *(count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")),
        count(F.col("illegal")).alias("illegal"),
    )


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``conv_id, at, initial, fault`` in; ``conv_id, cost, audit`` out, for whole conversations at a time."""

    def done(rows: pa.Table) -> pa.RecordBatch:
        starts = np.flatnonzero(np.asarray(pc.equal(rows["at"], 1)))
        lengths = np.diff(np.append(starts, rows.num_rows))
        fault = rows["fault"]
        goes = np.asarray(pc.fill_null(pc.is_in(fault, value_set=pa.array(["blank", "duplicate"])), False))
        toll = np.where(np.asarray(pc.fill_null(pc.equal(fault, "truncated"), False)), CUT, 0)
        found = walked(rows["initial"].to_numpy(), goes, toll, lengths)
        ids = rows["conv_id"].take(pa.array(starts)).combine_chunks()
        return pa.RecordBatch.from_arrays([ids, pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], ["conv_id", "cost", "audit"])

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < BATCH:
            continue
        rows = pa.Table.from_batches(held)
        open_at = int(np.flatnonzero(np.asarray(pc.equal(rows["at"], 1)))[-1])  # the last conversation may go on
        if open_at:
            yield done(rows.slice(0, open_at))
            rows = rows.slice(open_at)
        held, n = rows.combine_chunks().to_batches(), rows.num_rows
    if n:
        yield done(pa.Table.from_batches(held))


def walks(turns: DataFrame) -> DataFrame:
    """``conv_id, cost, audit`` of each conversation that has turns."""
    flags = turns.where("lives").select("conv_id", "at", "initial", "fault")
    dealt = flags.repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return dealt.mapInArrow(_walks, f"conv_id {dict(turns.dtypes)['conv_id']}, cost long, audit string")


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``conv_id, at, role, text, audit`` in, each conversation's audit before its turns; repaired rows out."""
    names = ["conv_id", "at", "edit", "role", "text"]
    audit, used, state, number = "", 0, START, 0
    for part in slices(batches):
        out: list[tuple] = []

        def put(conv, edit: str, role: str, text: str, out=out) -> None:
            nonlocal state, number
            number += 1
            state = AFTER[state][role[0]]
            out.append((conv, number, edit, role, text))

        for conv, at, role, text, plan in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
            if at == 0:
                audit, used, state, number = plan, 0, START, 0
                out.append((conv, 0, "", "", ""))
            else:
                while audit[used] == "I":
                    put(conv, "I", ROLE[state], "")
                    used += 1
                if audit[used] == "K":
                    put(conv, "K", role, text)
                elif audit[used] == "R":
                    put(conv, "R", ROLE[state], text)
                used += 1
            if not audit[used:].strip("I"):  # this was the last row
                for _ in range(len(audit) - used):
                    put(conv, "I", ROLE[state], "")
                used = len(audit)
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], part.column(0).type), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.string()) for c in columns[2:])], names)


def applied(turns: DataFrame, summary: DataFrame) -> DataFrame:
    """Repaired rows ``conv_id, at, edit, role, text``, in order within a partition, after one row at 0 for each conversation."""
    kind = dict(turns.dtypes)["conv_id"]
    heads = summary.select("conv_id", F.lit(0).cast("int").alias("at"), F.lit("").alias("role"), F.lit("").alias("text"), "audit")
    rows = turns.where("lives").select("conv_id", "at", "role", "text", F.lit(None).cast("string").alias("audit"))
    dealt = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return dealt.mapInArrow(_applied, f"conv_id {kind}, at long, edit string, role string, text string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list = []
    sums: list[str] = []
    digest = None
    kind = None
    for part in slices(batches):
        kind = part.column(0).type
        for conv, at, role, text in zip(*(part.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
            if at == 0:
                if digest:
                    sums.append(digest.hexdigest())
                ids.append(conv)
                digest = hashlib.sha256()
            else:
                digest.update(f"{chr(10) if at > 1 else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        if len(sums) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(ids[:-1], kind), pa.array(sums)], ["conv_id", "repaired_sha256"])
            ids, sums = ids[-1:], []
    if digest:
        sums.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(sums)], ["conv_id", "repaired_sha256"])


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: sha256 of the repaired ``role:text`` lines. Takes ``applied``'s rows as they come, in their order."""
    return repaired.mapInArrow(_digests, f"conv_id {dict(repaired.dtypes)['conv_id']}, repaired_sha256 string")


def repair(conversations: DataFrame, lives: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``(summary, turns)`` of ``conversations(conv_id, turn, role, text)``.

    ``summary`` has one row a conversation: ``conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit``; ``turns`` are its marked rows. Give both
    to ``applied`` for the repaired rows.

    Null role or text: one space, which makes a row blank or a role without a
    place. A null conv_id is one conversation of its own. Null turns come
    first. Ties of a turn go by role, then text; repeated rows are duplicates.
    Roles count by their first character; an empty role has none. Very long
    texts are held one at a time. Other columns play no part. Empty table: no
    rows. Where ``lives`` is false a row only says that its conversation exists.
    """
    space = lambda c: F.coalesce(conversations[c].cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select(conversations["conv_id"], conversations["turn"].cast("long").alias("turn"), space("role"), space("text"), (F.lit(True) if lives is None else lives).alias("lives"))
    turns = materialize(marked(rows), "turns")
    found, walk = faults(turns), walks(turns)
    walk = walk.withColumnRenamed("conv_id", "walked_id")
    summary = found.join(walk, found["conv_id"].eqNullSafe(walk["walked_id"]), "left").drop("walked_id")
    return materialize(summary.select(*found.columns, F.coalesce("cost", F.lit(0)).alias("cost"), F.coalesce("audit", F.lit("")).alias("audit")), "audits"), turns


def damaged(conversations: DataFrame) -> DataFrame:
    """The test damage, by crc32 of ``conv_id:turn`` modulo 20, with ``lives`` false for a dropped row. Nulls are one space."""
    text = lambda c: F.coalesce(conversations[c].cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select(conversations["conv_id"], conversations["turn"].cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    said = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), said.alias("text"), (F.col("kind") != 0).alias("lives"), copies.alias("copy")).drop("copy")


#: DuckDB SQL of the query's columns over ``conversations``; crc32 by its table.
ORACLE = r"""
WITH RECURSIVE bits(i, c, k) AS (SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
kinds AS (SELECT name, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda ch: ascii(ch)::BIGINT)), lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS kind FROM (SELECT DISTINCT name FROM named), crc),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM named JOIN kinds USING (name), range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, left(role, 1) AS i, right(regexp_replace(text, '[ \t\n\x0B\f\r]+$', ''), 1) AS z FROM hurt),
faulty AS (
  SELECT *, CASE WHEN z = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN z NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    coalesce(lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i NOT IN ('su', 'ua', 'au'), false) AS bad FROM placed),
-- one edit at a time: a state is what has been emitted last ('-' nothing), n the turns done
one(state, i, into_state) AS (VALUES ('-', 's', 's'), ('-', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
lengths AS (SELECT conv_id, count(*) AS len FROM placed GROUP BY conv_id),
walk(conv_id, n, state, cost, audit, ins, out) AS (
  SELECT conv_id, 0::BIGINT, '-', 0, '', 0, []::VARCHAR[] FROM lengths
  UNION ALL
  SELECT conv_id, n, state, cost, audit, ins, out FROM (
    SELECT w.conv_id, w.n + 1 AS n, w.state, w.cost + 4 AS cost, w.audit || 'D' AS audit, 0 AS ins, w.out FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.n + 1
    UNION ALL
    SELECT w.conv_id, w.n + 1, o.into_state, w.cost + (f.fault = 'truncated')::INT * 3, w.audit || 'K', 0, list_append(w.out, f.role || ':' || f.text) FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.n + 1 JOIN one o ON o.state = w.state AND o.i = f.i WHERE f.fault NOT IN ('blank', 'duplicate')
    UNION ALL
    SELECT w.conv_id, w.n + 1, o.into_state, w.cost + 3 + (f.fault = 'truncated')::INT * 3, w.audit || 'R', 0, list_append(w.out, CASE o.i WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text) FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.n + 1 JOIN one o ON o.state = w.state AND o.i <> 's' WHERE f.fault NOT IN ('blank', 'duplicate')
    UNION ALL
    SELECT w.conv_id, w.n, o.into_state, w.cost + 3, w.audit || 'I', w.ins + 1, list_append(w.out, CASE o.i WHEN 'u' THEN 'user:' ELSE 'assistant:' END) FROM walk w JOIN one o ON o.state = w.state AND o.i <> 's' WHERE w.ins < 2)
  QUALIFY row_number() OVER (PARTITION BY conv_id, n, state, ins ORDER BY cost, audit) = 1),
best AS (SELECT w.conv_id, arg_min({'c': cost, 'a': audit, 'o': out}, {'c': cost, 'a': audit}) AS b FROM walk w JOIN lengths l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.len = w.n WHERE state IN ('-', 'a') GROUP BY w.conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal FROM faulty GROUP BY conv_id)
SELECT a.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
  coalesce(b.b.c, 0)::BIGINT AS cost, coalesce(b.b.a, '') AS audit, sha256(coalesce(array_to_string(b.b.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM a.conv_id"""
