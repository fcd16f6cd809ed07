import hashlib
import random
import re
from itertools import product

import pytest

from quarryline.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string"
WANTED = re.compile(r"(s?(ua)+)?")


def brute(rows):
    """Cheapest ``(cost, audit, repaired)`` of ``(role, text, fault)`` rows among all edit sequences with up to two rows inserted at a place."""
    inserts = [x for n in range(3) for x in product(("user", "assistant"), repeat=n)]
    best = None
    edits = [[(4, "D", None)] + ([] if f in ("blank", "duplicate") else [(t, "K", (r, x)), (3 + t, "R", ("user", x)), (3 + t, "R", ("assistant", x))]) for r, x, f in rows for t in [3 * (f == "truncated")]]
    for picked in product(*edits):
        for put in product(inserts, repeat=len(rows) + 1):
            cost = sum(e[0] for e in picked) + 3 * sum(map(len, put))
            if best and cost > best[0]:
                continue
            out, audit = [], ""
            for i, new in enumerate(put):
                out += [(r, "") for r in new]
                audit += "I" * len(new)
                if i < len(picked):
                    audit += picked[i][1]
                    out += [picked[i][2]] if picked[i][2] else []
            if WANTED.fullmatch("".join(r[:1] or "?" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, out)
    return best


def faults(rows):
    """``(role, text, fault)`` of rows in order."""
    out, seen = [], set()
    for role, text in rows:
        last = text.rstrip(repair.BLANK_CHARS)[-1:]
        out.append((role, text, "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None))
        seen.add((role, text))
    return out


def repaired(spark, rows, schema=SCHEMA):
    summary, turns = repair.repair(spark.createDataFrame(rows, schema))
    lines = {}
    for r in sorted(repair.applied(turns, summary).collect(), key=lambda r: r["at"]):
        lines.setdefault(r["conv_id"], []).extend([(r["role"], r["text"])] if r["at"] else [])
    return {r["conv_id"]: (r, lines[r["conv_id"]]) for r in summary.collect()}


@pytest.mark.parametrize("span", [1, 2, 64])
def test_equals_all_edit_sequences(spark, monkeypatch, span):
    rng = random.Random(span)
    convs = {}
    for c in range(60):
        convs[c] = [(rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(["Yes.", "No!", "cut off", "", " \n", "Why? \t"])) for _ in range(rng.randint(0, 3))]
    rows = [(c, t, r, x) for c, turns in convs.items() for t, (r, x) in enumerate(turns)]
    # pieces are cut where Python workers run, so the walk itself is called here
    monkeypatch.setattr(repair, "SPAN", span)
    import numpy as np

    marked = {c: faults(turns) for c, turns in convs.items() if turns}
    flat = [x for turns in marked.values() for x in turns]
    found = repair.walked(np.array([r[:1] for r, _, _ in flat], object), np.array([f in ("blank", "duplicate") for *_, f in flat]), np.array([3 * (f == "truncated") for *_, f in flat]), np.array([len(t) for t in marked.values()]))
    want = {c: brute(turns) for c, turns in marked.items()}
    assert dict(zip(marked, found, strict=True)) == {c: w[:2] for c, w in want.items()}
    if span == 64:
        got = repaired(spark, rows)
        assert {c: (g["cost"], g["audit"], lines) for c, (g, lines) in got.items()} == want


def test_long_conversations_in_pieces(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), f"{t}" + rng.choice([".", ""])) for t in range(500)] + [(8, 0, "user", "Hi."), (8, 1, "assistant", "Ho.")]
    got = repaired(spark, rows)
    monkeypatch.setattr(repair, "SPAN", 1000)
    import numpy as np

    flat = faults([(r, x) for c, _, r, x in rows if c == 7])
    whole = repair.walked(np.array([r[0] for r, _, _ in flat], object), np.zeros(500, bool), np.array([3 * (f == "truncated") for *_, f in flat]), np.array([500]))
    assert (got[7][0]["cost"], got[7][0]["audit"]) == whole[0]
    assert WANTED.fullmatch("".join(r[0] for r, _ in got[7][1]))
    assert got[8][0]["audit"] == "KK"


def test_counts_nulls_ties_and_clashing_columns(spark):
    rows = [
        (None, 3, "user", "Hi.", 1),
        (None, 7, "assistant", None, 1),
        (1, None, None, "x.", 1),
        (1, None, "user", "b.", 1),
        (1, None, "user", "b.", 1),
        (2, 5, "user", "a" * 100_000, 1),
        (2, 5, "assistant", "b?\r\n", 1),
        (3, 4, "assistant", "First.", 1),
        (3, 9, "user", "First.", 1),
    ]
    frame = spark.createDataFrame(rows, SCHEMA + ", `a.b` int").withColumnRenamed("a.b", "at.lives")
    summary, turns = repair.repair(frame)
    got = {r["conv_id"]: tuple(r)[1:] for r in summary.collect()}
    assert got[None] == (3, 1, 0, 0, 0, 7, "KDI")
    assert got[3] == (4, 0, 0, 0, 0, 6, "IKKI")
    assert got[1][:5] == (0, 0, 1, 0, 2)  # null turns leave no gaps; rows in order of role: ' ', user, user
    assert got[2][:5] == (0, 0, 0, 1, 0)  # of one turn the assistant sorts first


def test_empty_table_and_dropped_rows(spark):
    assert repaired(spark, []) == {}
    rows = spark.createDataFrame([(1, 0, "user", "Hi.")], SCHEMA)
    summary, turns = repair.repair(rows, rows["turn"] > 5)
    assert [tuple(r) for r in summary.collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
    assert [r["repaired_sha256"] for r in repair.digests(repair.applied(turns, summary)).collect()] == [hashlib.sha256(b"").hexdigest()]


def test_query_returns_every_conversation(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for c in range(40) for t in range(c % 5 + 1)] + [(None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_repair(spark, str(tmp_path)).collect()
    assert {r["conv_id"] for r in got} == {None, *range(40)} and len(got) == 41
