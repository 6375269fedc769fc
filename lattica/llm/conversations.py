"""Conversation structure repair by weighted finite-state composition.

Three machines are composed. The input acceptor is the line of a conversation's rows. The edit transducer keeps a row (K),
gives it another role (R), deletes it (D) or inserts one with no text (I), each at a cost. The grammar acceptor takes the role
initials `(s?(ua)+)?`. The composed states (rows read, state of the grammar) and their arcs are made when the search gets
there. Weights are pairs (cost, labels), compared in this order. An insertion costs, so it never comes back to a state, and the
composed machine can be walked in topological order, with at most one insertion less than the grammar has states between two rows.

A conversation of any length is spread over tasks: rows are sorted over range partitions and cut into runs of at most ROWS rows
or BYTES of text, and each run becomes a matrix of the best weight between any two states of the grammar. Two weights of equal
cost that read the same rows are never one the beginning of the other, so that the best of a whole is made of bests of its
parts and matrices can be multiplied. The product is taken in a stream, which hands on runs as soon as all ways that can
still win agree on them. Equal rows are one row with a count before they are shuffled by conversation.

Defined results: rows are taken by turn (nulls first), then role, then text, both by their bytes; null roles and texts are one
space; a conversation whose id is null is one like any other. A row is blank (no word), else a duplicate (its role and text
came before), else truncated (its last character that isn't white space isn't one of `.!?`), else sound. Blank rows and
duplicates have to go. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, written
from .hashing import slices

ROWS, BYTES = 1000, 1_000_000
#: Costs of edits; of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The grammar (s?(ua)+)?: what each state reads, and where that leads. It ends in START or PAIR.
START, SYSTEM, USER, PAIR = range(4)
GRAMMAR = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": PAIR}, PAIR: {"u": USER}}
FINAL = (START, PAIR)
NAMES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
#: (state, other, more): from `other` every ending of `state` can be had at `more` at most, so a state that costs more is lost.
LOST = ((START, PAIR, DELETE), (START, USER, DELETE + INSERT), (SYSTEM, PAIR, 0), (SYSTEM, USER, INSERT), (USER, PAIR, INSERT), (PAIR, USER, INSERT))

_RUN = (
    "conv_id long, part int, seq long, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
    "turns long, low long, high long, weights array<struct<start:int,end:int,cost:long,edits:string>>, roles array<string>, texts array<string>, times array<long>"
)
_REPAIRED = (
    "conv_id long, run long, final boolean, edits string, roles array<string>, texts array<string>, "
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
)


def _inserted(ways: dict) -> dict:
    """The best weights with insertions after them."""
    for _ in range(len(GRAMMAR) - 1):
        for state, (cost, edits) in list(ways.items()):
            for symbol, to in GRAMMAR[state].items():
                if symbol in NAMES:
                    way = (cost + INSERT, edits + "I")
                    if to not in ways or way < ways[to]:
                        ways[to] = way
    return ways


def _read(ways: dict, initial: str, gone: bool, cut: bool, times: int) -> dict:
    """The best weights after one more row, which comes `times` times; those after the first are duplicates."""
    out: dict = {}
    for state, (cost, edits) in ways.items():
        arcs = [("D", DELETE, state)]
        if not gone:
            more = TRUNCATED if cut else 0
            for symbol, to in GRAMMAR[state].items():
                if symbol == initial:
                    arcs.append(("K", more, to))
                if symbol in NAMES:
                    arcs.append(("R", more + REROLE, to))
        for label, price, to in arcs:
            # the copies go before anything is inserted: D is before I
            way = (cost + price + DELETE * (times - 1), edits + label + "D" * (times - 1))
            if to not in out or way < out[to]:
                out[to] = way
    return _inserted(out)


def _applied(state: int, edits: str, roles: list, texts: list, times: list) -> tuple[list, list]:
    """Roles and texts of a run's rows after its edits, from a state of the grammar on."""
    rows = ((r, t) for r, t, n in zip(roles, texts, times) for _ in range(n))
    new_roles, new_texts = [], []
    for e in edits:
        role, text = (None, "") if e == "I" else next(rows)
        if e == "D":
            continue
        if e != "K":
            role = next(NAMES[symbol] for symbol in GRAMMAR[state] if symbol in NAMES)
        state = GRAMMAR[state][role[:1]]
        new_roles.append(role)
        new_texts.append(text)
    return new_roles, new_texts


def _marked(turns: DataFrame) -> DataFrame:
    """Equal rows as one with a count (`times`), and whether role and text have come at an earlier turn (`later`)."""
    text = [F.xxhash64("text"), F.xxhash64(F.lit(7), "text")]
    same = turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    same = same.select("*", text[0].alias("t1"), text[1].alias("t2"))
    first = turns.select("conv_id", "role", text[0].alias("t1"), text[1].alias("t2"), F.struct(F.col("turn")).alias("at"))
    first = first.groupBy("conv_id", "role", "t1", "t2").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    first = first.where(~F.col("first").eqNullSafe(F.col("last"))).select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("t1").alias("u1"), F.col("t2").alias("u2"), "first")
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2"))
    later = F.col("first").isNotNull() & ~F.struct(F.col("turn")).eqNullSafe(F.col("first"))
    return same.join(first, on, "left").select("conv_id", "turn", "role", "text", "times", later.alias("later"))


def _runs(rows: DataFrame) -> DataFrame:
    """Each partition's rows, which come in order, as runs of one conversation each."""
    schema = _schema(_RUN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, now, top = TaskContext.get().partitionId(), 0, None, True

        def opened(row: dict, top: bool) -> dict:
            # only a run at the top of a partition can go on from another one's; and those that were cut
            ways = {s: _inserted({s: (0, "")}) for s in (GRAMMAR if top else (START,))}
            return dict.fromkeys(("n", "blank", "duplicate", "truncated", "illegal", "turns", "size"), 0) | {
                "conv_id": row["conv_id"], "first": row["initial"], "low": None, "high": None, "last": None, "turn": None, "ways": ways, "roles": [], "texts": [], "times": [],
            }

        def closed(r: dict) -> dict:
            weights = [{"start": s, "end": e, "cost": c, "edits": x} for s, ends in r.pop("ways").items() for e, (c, x) in ends.items()]
            return r | {"part": part, "seq": seq, "weights": weights}

        for batch in slices(batches):
            done = []
            for row in batch.to_pylist():
                same = now is not None and now["conv_id"] == row["conv_id"]
                if now is not None and (not same or now["n"] >= ROWS or now["size"] >= BYTES):
                    done.append(closed(now))
                    seq, top, now = seq + 1, same, None
                if now is None:
                    now = opened(row, top)
                n, blank, gone = row["times"], row["blank"], row["blank"] or row["later"]
                cut = not gone and row["cut"]
                now["ways"] = {s: _read(w, row["initial"], gone, cut, n) for s, w in now["ways"].items()}
                now["blank"] += n if blank else 0
                now["duplicate"] += 0 if blank else n - 1 + row["later"]
                now["truncated"] += cut
                now["illegal"] += (now["last"] is not None and now["last"] + row["initial"] not in LEGAL) + (n - 1) * (row["initial"] * 2 not in LEGAL)
                now["n"] += 1
                now["size"] += len(row["text"])
                now["last"] = row["initial"]
                if row["turn"] is not None:
                    now["turns"] += row["turn"] != now["high"]
                    now["low"] = row["turn"] if now["low"] is None else now["low"]
                    now["high"] = row["turn"]
                for name in ("role", "text"):
                    now[f"{name}s"].append(row[name])
                now["times"].append(n)
            yield pa.RecordBatch.from_pylist(done, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([closed(now)], schema)

    blank = F.length(F.btrim("text", F.lit(WS))) == 0
    ending = F.right(F.btrim("text", F.lit(WS)), F.lit(1))
    rows = rows.withColumns({"initial": F.substring("role", 1, 1), "blank": blank, "cut": ~ending.isin(".", "!", "?")})
    return rows.mapInArrow(run, _RUN)


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches, of which few are Python objects at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            yield from batch.slice(a, 64).to_pylist()


def _joined(runs: DataFrame) -> DataFrame:
    """The repaired runs of conversations whose runs come in order."""
    schema, counts = _schema(_REPAIRED), ("blank", "duplicate", "truncated", "illegal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None
        out: list[dict] = []

        def opened(conv_id: int | None) -> dict:
            return dict.fromkeys((*counts, "turns"), 0) | {"conv_id": conv_id, "run": 0, "low": None, "high": None, "last": None, "ways": {START: (0, "")}, "held": []}

        def added(now: dict, r: dict) -> None:
            """One more run, with the way that leads to each state."""
            between = {(w["start"], w["end"]): (w["cost"], w["edits"]) for w in r["weights"]}
            ways, came = {}, {}
            for (start, end), (cost, edits) in between.items():
                if start in now["ways"]:
                    way = (now["ways"][start][0] + cost, now["ways"][start][1] + edits)
                    if end not in ways or way < ways[end]:
                        ways[end], came[end] = way, (start, edits)
            for state, other, more in LOST:
                if state in ways and other in ways and ways[state][0] > ways[other][0] + more:
                    del ways[state], came[state]
            now["ways"] = ways
            now["held"].append((r, came))
            for c in counts:
                now[c] += r[c]
            now["illegal"] += now["last"] is not None and now["last"] + r["first"] not in LEGAL
            now["last"] = r["last"]
            if r["low"] is not None:
                now["turns"] += r["turns"] - (r["low"] == now["high"])
                now["low"] = r["low"] if now["low"] is None else now["low"]
                now["high"] = r["high"]

        def settled(now: dict, states: set[int], upto: int) -> list[dict]:
            """The first `upto` runs as far as the ways to all these states agree on them."""
            back = []
            for r, came in reversed(now["held"]):
                back.append((r, came, states))
                states = {came[s][0] for s in states}
            back = back[::-1][:upto]
            agreed = [i for i, x in enumerate(back) if len(x[2]) == 1]
            out = []
            for r, came, (state,) in back[: agreed[-1] + 1] if agreed else ():
                start, edits = came[state]
                roles, texts = _applied(start, edits, r["roles"], r["texts"], r["times"])
                out.append({"conv_id": now["conv_id"], "run": now["run"], "final": False, "edits": edits, "roles": roles, "texts": texts})
                now["run"] += 1
            # from here on only what follows tells ways apart
            done = sum(len(x["edits"]) for x in out)
            now["held"] = now["held"][len(out) :]
            now["ways"] = {s: (c, e[done:]) for s, (c, e) in now["ways"].items()}
            return out

        def closed(now: dict) -> list[dict]:
            end = min((now["ways"][s], s) for s in FINAL if s in now["ways"])
            out = settled(now, {end[1]}, len(now["held"]))
            gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
            out[-1] |= {c: now[c] for c in counts} | {"final": True, "gaps": gaps, "cost": end[0][0]}
            return out

        for r in _few(batches):
            if now is not None and now["conv_id"] != r["conv_id"]:
                out += closed(now)
                now = None
            now = opened(r["conv_id"]) if now is None else now
            added(now, r)
            out += settled(now, set(now["ways"]), len(now["held"]) - 1)
            if sum(len(x["texts"]) for x in out) > ROWS:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if now is not None:
            out += closed(now)
        yield pa.RecordBatch.from_pylist(out, schema)

    return runs.mapInArrow(run, _REPAIRED)


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations: (conv_id, run, final, edits, roles, texts, gaps, blank, duplicate, truncated, illegal, cost).

    A row is a run of a conversation's rows, with their edits and the roles and texts that these leave. A conversation's runs
    come in order within one partition; the final one has the counts and the cost of the whole conversation. gaps: turns that
    are missing between its least and largest one. A column `times` of `turns`, where there is one, isn't read.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"))
    return _repaired(rows.withColumn("times", F.lit(1).cast("long")))


def _repaired(rows: DataFrame) -> DataFrame:
    marked = written(_marked(rows))
    order = ["conv_id", "turn", "role"]
    # the beginning of the text is enough to deal rows out, as equal ones are one
    dealt = marked.repartitionByRange(*order, F.substring("text", 1, 32)).sortWithinPartitions(*order, "text")
    return _joined(_runs(dealt).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq"))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times): the rows with planted faults, by a hash of conversation and turn."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(fault == 4, "user").otherwise(space("role"))
    rows = conversations.where(fault != 0)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.when(fault == 3, 2).otherwise(1).cast("long").alias("times"))


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _digests(repaired: DataFrame) -> DataFrame:
    """One row per conversation: the counts, all edits and a digest of what is left; runs come in order."""
    ddl = "conv_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
    schema = _schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, edits, empty, done = sha256(), [], True, []
        for r in _few(batches):
            for role, text in zip(r["roles"], r["texts"]):
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
            edits.append(r["edits"])
            if r["final"]:
                done.append({c: r[c] for c in ("conv_id", *_COUNTS)} | {"audit": "".join(edits), "repaired_sha256": digest.hexdigest()})
                digest, edits, empty = sha256(), [], True
            if len(done) == ROWS:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        yield pa.RecordBatch.from_pylist(done, schema)

    return repaired.mapInArrow(run, ddl)


def conversation_repair_report(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, after damage."""
    made = _digests(_repaired(damaged(conversations))).withColumnRenamed("conv_id", "of")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = ids.join(made, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in _COUNTS}
    texts = {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))}
    return out.select("conv_id", *[v.alias(k) for k, v in (zero | texts).items()])
