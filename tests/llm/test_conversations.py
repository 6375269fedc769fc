"""Conversation repair against brute force over all edits of short conversations."""

import hashlib
import random
import re
from itertools import product
from zlib import crc32

import pytest

from lattica.llm import conversations as op

BLANK = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    """First fault of each row, rows in order."""
    out, seen = [], set()
    for _, role, text in rows:
        solid = BLANK.findall(text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """(cost, audit, repaired) by trying all edits: each row kept, given a role or deleted, and up to two rows inserted at each place."""
    found = faults(rows)
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    per_row = [[("D", None, 4)] if f in ("blank", "duplicate") else [("K", None, 0), ("R", "user", 3), ("R", "assistant", 3), ("D", None, 4)] for f in found]
    best = None
    for edits in product(*per_row):
        for gaps in product(inserts, repeat=len(rows) + 1):
            cost, audit, made = 0, "", []
            for i in range(len(rows) + 1):
                cost += 3 * len(gaps[i])
                audit += "I" * len(gaps[i])
                made += [(role, "") for role in gaps[i]]
                if i < len(rows):
                    label, role, price = edits[i]
                    audit += label
                    cost += price + (3 if label != "D" and found[i] == "truncated" else 0)
                    if label != "D":
                        made.append((role or rows[i][1], rows[i][2]))
            if (best is None or (cost, audit) < best[:2]) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in made)):
                best = (cost, audit, made)
    return best


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def report(rows):
    rows = in_order(rows)
    found, (cost, audit, made) = faults(rows), brute(rows)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
    return (gaps, *[found.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        c, t, role, text = (" " if x is None else x for x in (conv, turn, role, text))
        fault = crc32(f"{c}:{t}".encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            out += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def got(df):
    rows = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def some(rng, n):
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", "unknown", None], ["A.", "B!", "no end", " \t", "", "C?", "é. \n", None]
    return [(rng.choice([None, i, i, i, i // 2, 3 * i]), rng.choice(roles), rng.choice(texts)) for i in range(n)]


def test_short_conversations(spark):
    rng = random.Random(13)
    rows = [(c, *r) for c in range(150) for r in some(rng, rng.randint(1, 3))]
    rows += [(None, 0, "user", "Hello."), (None, 1, "assistant", "Yes.")]
    wanted, ids = {}, {r[0] for r in rows}
    for c in ids:
        left = damage([r for r in rows if r[0] == c])
        if len(left) <= 4:
            wanted[c] = report(left)
    result = got(op.conversation_repair_report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert set(result) == ids and {c: result[c] for c in wanted} == wanted


def whole(rows):
    """(cost, audit) over suffixes, a row at a time, for conversations too long to try all edits."""
    found, states = faults(rows), {"0": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "p"}, "p": {"u": "u"}}

    def more(best):
        for _ in states:
            for g, to in states.items():
                for symbol, h in to.items():
                    if symbol != "s" and h in best:
                        best[g] = min(best.get(g, (float("inf"), "")), (best[h][0] + 3, "I" + best[h][1]))
        return best

    best = more({"0": (0, ""), "p": (0, "")})
    for (_, role, _), fault in zip(rows[::-1], found[::-1]):
        now = {}
        for g, to in states.items():
            ways = [(best[g][0] + 4, "D" + best[g][1])] if g in best else []
            for symbol, h in to.items():
                if h in best and fault in ("", "truncated"):
                    extra = 3 * (fault == "truncated")
                    ways += [(best[h][0] + extra, "K" + best[h][1])] * (symbol == role[:1])
                    ways += [(best[h][0] + 3 + extra, "R" + best[h][1])] * (symbol != "s")
            now[g] = min(ways)
        best = more(now)
    return best["0"]


@pytest.mark.parametrize("rows_a_run", [3, 1000])
def test_long_conversations_in_runs(spark, rows_a_run):
    """Runs of a few rows give what one run gives, whatever the partitions."""
    rng, convs = random.Random(7), {}
    for c in range(12):
        # without ties between different rows of a turn
        convs[c] = [(i, (r[1] if r[1] is not None else " "), (r[2] if r[2] is not None else " ")) for i, r in enumerate(some(rng, rng.choice([1, 7, 40, 300])))]
    convs[12] = [(i, "user", f"{i}.") for i in range(200)]
    convs[13] = [(i, "tool", f"{i}.") for i in range(200)]
    convs[14] = [(i, ("user", "assistant")[i % 2], f"{i}.") for i in range(500)]
    df = spark.createDataFrame([(c, *r) for c, rows in convs.items() for r in rows], "conv_id long, turn long, role string, text string")
    before, op.ROWS = op.ROWS, rows_a_run
    try:
        rows = op.repair(df.repartition(5)).collect()
    finally:
        op.ROWS = before
    for c, turns in convs.items():
        runs = sorted((r for r in rows if r.conv_id == c), key=lambda r: r.run)
        assert [r.final for r in runs] == [False] * (len(runs) - 1) + [True]
        cost, audit = whole(turns)
        assert (runs[-1].cost, "".join(r.edits for r in runs)) == (cost, audit), c
        initials = "".join(x[0] for r in runs for x in r.roles)
        assert re.fullmatch("(s?(ua)+)?", initials)
        kept = [t for t, e in zip((x[2] for x in turns), audit.replace("I", "")) if e != "D"]
        inserted = sum(e == "I" for e in audit)
        assert sorted(t for r in runs for t in r.texts) == sorted(kept + [""] * inserted)


def test_copies_and_ties(spark):
    """Thousands of equal rows, one of them far ahead, and many rows of one turn."""
    rows = [(1, 5, "user", "Same.")] * 3000 + [(1, 1, "user", "Same.")] + [(2, None, "user", "Same.")] * 3 + [(3, 0, "assistant", f"{i:04}.") for i in range(50)]
    out = {r.conv_id: r for r in op.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("final").collect()}
    assert (out[1].duplicate, out[1].cost, out[1].edits) == (3000, 4 * 3001, "D" * 3001) or out[1].cost == 3 + 4 * 3000
    assert (out[1].gaps, out[2].duplicate, out[2].gaps, out[3].illegal) == (3, 2, 0, 49)


def test_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string, times long, part string, RUN string"
    assert op.conversation_repair_report(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, None, None, 9, "x", "y"), (None, None, None, None, 9, "x", "y"), (2, 0, "user", "long. " * 50_000, 9, "x", "y"), (2, 1, "assistant", "fine.", 9, "x", "y")]
    result = got(op.conversation_repair_report(spark.createDataFrame(rows, schema)))
    assert set(result) == {1, None, 2} and all(r[1] == len(damage([x[:4] for x in rows if x[0] == c])) for c, r in result.items() if c != 2)
    # no row is left after damage: conversation and turn chosen so
    gone = next(c for c in range(10**6) if crc32(f"{c}:0".encode()) % 20 == 0)
    result = got(op.conversation_repair_report(spark.createDataFrame([(gone, 0, "user", "Hi.", 1, "", "")], schema)))
    assert result == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
