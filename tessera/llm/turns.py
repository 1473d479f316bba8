"""Repair of conversation structure by Hirschberg's divide and conquer.

A conversation's roles shall read ``(s?(ua)+)?`` by their initials. Rows are kept
(K, free), get another role (R, 1), are deleted (D, 2; blank and duplicate rows
must be) and empty user or assistant rows are inserted (I, 5); a truncated row
that stays costs 5 more. The grammar is an automaton of four states: nothing yet,
after the system row, after a user row, after an assistant row. A row is a 4 x 4
table of costs from state to state, a run of rows is the product of its rows'
tables in (min, +), and the state after some rows follows from their audit alone.

Audit-least. Up to a row's own edit audits of the same rows are prefix-free (each
holds as many non-inserts and ends in one), so of two audits that cross a row
border in different states the one with the lesser left part is lesser as a
whole. A forward vector therefore carries, besides the least cost of each state,
the rank of the least of the cheapest audits that lead there; where forward and
backward vectors meet, the crossing of least cost and then of least rank is the
right one. Both halves are solved in the same way, in space linear in the rows.

Distribution. Rows are dealt by range of (conversation, turn, role, hash of the
text, place in the input), so a task holds whole conversations, and pieces of at
most two, however many rows one conversation has. Whole ones are solved in place.
A piece becomes its 4 x 4 table; forward and backward vectors over a
conversation's tables meet at the piece borders and fix each piece's first and
last state, and the pieces are solved on their own. Texts seen in an earlier piece
come from one aggregate over the pieces' first sightings. Only the digest of a
conversation that lies on several tasks is read in one stream, as SHA-256 has
no sums of parts: its rows pass in order through constant memory.

Nulls: a null role or text is one space, in the damage key too; null turns come
first; a null conv_id is one conversation. Rows of equal turn go by role, then by
hash of the text. Repeated rows are duplicates. Extra columns are ignored. An
empty table gives an empty result. Texts are compared by 64-bit hash."""

from __future__ import annotations

import functools
import hashlib
import itertools
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tessera.session import ensure_checkpoint_dir

PIECE_BYTES = 64 << 20
NONE = 1 << 60                                      # cost of what cannot be
NEXT_ROLE = ("user", "user", "assistant", "user")   # the role that goes on from each state
NEXT_STATE = (2, 2, 3, 2)
CLOSE = (0, 10, 5, 0)                               # cost of the inserts that complete each state
TRAIL = ("", "II", "I", "")
DELETE_ONLY = 8                                     # row classes: initial s, u, a, other (0-3); truncated 4-7; must go
LEGAL = {(0, 1), (1, 2), (2, 1)}                    # su, ua, au


class Step:
    """Costs from state to state and, from each state, the order of the audits."""

    __slots__ = ("cost", "order")

    def __init__(self, cost, order):
        self.cost, self.order = cost, order


@functools.lru_cache(None)
def row_edits(kind: int) -> tuple:
    """[from][to] = (cost, edits) of the cheapest, ASCII-least edits of one row,
    inserts before it included; None where there are none."""
    best = [[None] * 4 for _ in range(4)]

    def offer(a: int, b: int, cost: int, text: str) -> None:
        if best[a][b] is None or (cost, text) < best[a][b]:
            best[a][b] = (cost, text)

    for a in range(4):
        q = a
        for inserts in range(3):
            put, paid = "I" * inserts, 5 * inserts
            offer(a, q, paid + 2, put + "D")
            if kind != DELETE_ONLY:
                stay, initial = paid + (5 if kind >= 4 else 0), kind % 4
                if initial == 0 and q == 0:
                    offer(a, 1, stay, put + "K")
                if initial == (2 if q == 2 else 1):
                    offer(a, NEXT_STATE[q], stay, put + "K")
                offer(a, NEXT_STATE[q], stay + 1, put + "R")
            q = NEXT_STATE[q]
    return tuple(map(tuple, best))


@functools.lru_cache(None)
def row_step(kind: int) -> Step:
    e = row_edits(kind)
    cost = tuple(tuple(c[0] if c else NONE for c in line) for line in e)
    order = []
    for line in e:
        by = sorted((b for b in range(4) if line[b]), key=lambda b: line[b][1])
        order.append(tuple(by.index(b) if b in by else 4 for b in range(4)))
    return Step(cost, tuple(order))


def forward(vector: tuple, step: Step) -> tuple[tuple, int]:
    """((costs less the least, ranks), the least cost) one step on."""
    cost, rank = vector
    found = []
    for b in range(4):
        found.append(min(((cost[a] + step.cost[a][b], rank[a], step.order[a][b]) for a in range(4)), default=None))
    least = min(f[0] for f in found)
    by = sorted(range(4), key=lambda b: found[b][1:] if found[b][0] < NONE else (9,))
    return (tuple(f[0] - least if f[0] < NONE else NONE for f in found), tuple(by.index(b) for b in range(4))), least


def backward(cost: tuple, step: Step) -> tuple[tuple, int]:
    """(costs to the end less the least, the least) one step back."""
    out = [min(step.cost[a][b] + cost[b] for b in range(4)) for a in range(4)]
    least = min(out)
    return tuple(c - least if c < NONE else NONE for c in out), least


def start(q: int) -> tuple:
    return tuple(0 if a == q else NONE for a in range(4)), (0, 1, 2, 3)


def ends(q: int) -> tuple:
    return tuple(0 if a == q else NONE for a in range(4))


_ROW_FORWARD: dict = {}
_ROW_BACK: dict = {}


def over(vector: tuple, steps) -> tuple[tuple, int]:
    """Forward vector over steps; row classes (ints) go by a table of vectors,
    of which there are few, as costs differ by the price of two inserts at most."""
    total = 0
    for s in steps:
        if isinstance(s, int):
            got = _ROW_FORWARD.get((vector, s))
            if got is None:
                got = _ROW_FORWARD[vector, s] = forward(vector, row_step(s))
            vector, add = got
        else:
            vector, add = forward(vector, s)
        total += add
    return vector, total


def back_over(cost: tuple, steps) -> tuple[tuple, int]:
    total = 0
    for s in reversed(steps):
        if isinstance(s, int):
            got = _ROW_BACK.get((cost, s))
            if got is None:
                got = _ROW_BACK[cost, s] = backward(cost, row_step(s))
            cost, add = got
        else:
            cost, add = backward(cost, s)
        total += add
    return cost, total


def crossing(vector: tuple, cost: tuple) -> int:
    """State of the cheapest, and of these the audit-least, way through a border."""
    return min((vector[0][q] + cost[q], vector[1][q], q) for q in range(4))[2]


def borders(steps, q0: int, q1: int) -> Iterator[int]:
    """State after each step of the audit-least cheapest way from q0 to q1."""
    if len(steps) == 1:
        yield q1
        return
    mid = len(steps) // 2
    meet = crossing(over(start(q0), steps[:mid])[0], back_over(ends(q1), steps[mid:])[0])
    yield from borders(steps[:mid], q0, meet)
    yield from borders(steps[mid:], meet, q1)


def solve(steps) -> tuple[int, int]:
    """(cost, last state) of the best way from nothing through all steps."""
    vector, total = over(start(0), steps)
    last = crossing(vector, CLOSE)
    return total + vector[0][last] + CLOSE[last], last


def edits(kinds: list[int], q0: int, q1: int) -> Iterator[tuple[int, str]]:
    """(state before, edits) of each row."""
    q = q0
    for kind, after in zip(kinds, borders(kinds, q0, q1) if kinds else ()):
        yield q, row_edits(kind)[q][after][1]
        q = after


def lines(q: int, text: str, role: str | None, body: str | None) -> Iterator[str]:
    """Repaired rows that one row's edits give."""
    for e in text:
        if e == "D":
            continue
        put = role if e == "K" else NEXT_ROLE[q]
        yield put + ":" + ("" if e == "I" else body)
        q = 1 if e == "K" and q == 0 and role[:1] == "s" else NEXT_STATE[q]


INITIAL = {"s": 0, "u": 1, "a": 2}
DONE = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damage(df: DataFrame) -> DataFrame:
    """The damaged rows of (conv, turn, role, text); rows taken away stay as marks
    without content, so that their conversations are not forgotten."""
    k = F.crc32(F.concat(F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.lit(":"),
                         F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    text = F.when(k <= 1, F.lit("")).when(k == 2, F.translate(text, ".!?", "")).otherwise(text)
    rows = df.select("conv", "turn", F.when(k == 0, F.lit("")).when(k == 4, F.lit("user")).otherwise(role).alias("role"), text.alias("text"),
                     (k == 0).alias("dropped"), F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("n"))
    return rows.select("conv", "turn", "role", "text", "dropped", F.explode("n").alias("again")).drop("again")


def mark_faults(rows: DataFrame) -> DataFrame:
    """Rows with the fault that a row shows alone: 1 blank, 2 truncated, 0 none."""
    solid = F.expr("rtrim(' \\t\\n\\u000B\\u000C\\r', text)")
    last = F.right(solid, F.lit(1))
    fault = F.when(solid == "", 1).when(last.isin(".", "!", "?"), 0).otherwise(2)
    return rows.select("conv", "turn", "role", "text", F.xxhash64("role", "text").alias("key"), fault.alias("fault"), "dropped")


def _kind(role: str, fault: int, dup: bool) -> int:
    if fault == 1 or dup:
        return DELETE_ONLY
    return INITIAL.get(role[:1], 3) + (4 if fault == 2 else 0)


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def _pieces(rows: DataFrame, conv_type: str) -> DataFrame:
    """Whole conversations solved; rows of those that may reach over a task's
    range numbered by (part, seq), with ``fresh``: first of its text in the part."""
    schema = (f"whole boolean, conv {conv_type}, {DONE}, part int, seq long, turn long, role string, text string, key long, fault int, "
              "dropped boolean, fresh boolean")
    arrow = _arrow(schema)

    def whole(conv, got: list[tuple]) -> tuple:
        live = [r for r in got if not r[6]]
        if not live:
            return (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        seen, kinds, faults = set(), [], [0, 0, 0]
        for r in live:
            dup = r[5] != 1 and r[4] in seen
            seen.add(r[4])
            if r[5] == 1 or dup or r[5] == 2:
                faults[0 if r[5] == 1 else 1 if dup else 2] += 1
            kinds.append(_kind(r[2], r[5], dup))
        turns = [r[1] for r in live if r[1] is not None]
        initials = [INITIAL.get(r[2][:1], 3) for r in live]
        cost, last = solve(kinds)
        audit, sha, sep = [], hashlib.sha256(), b""
        for r, (q, e) in zip(live, edits(kinds, 0, last)):
            audit.append(e)
            for line in lines(q, e, r[2], r[3]):
                sha.update(sep + line.encode())
                sep = b"\n"
        for line in lines(last, TRAIL[last], None, None):
            sha.update(sep + line.encode())
            sep = b"\n"
        return (conv, turns[-1] - turns[0] + 1 - len(set(turns)) if turns else 0, *faults,
                sum(p not in LEGAL for p in itertools.pairwise(initials)), cost, "".join(audit) + TRAIL[last], sha.hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, first = TaskContext.get().partitionId(), itertools.count(), [], True

        def opened(got: list[tuple]) -> list[tuple]:
            seen, out = set(), []
            for conv, turn, role, text, key, fault, dropped in got:
                fresh = not dropped and fault != 1 and key not in seen
                seen.add(key)
                out.append((False, conv, *[None] * 8, part, next(seq), turn, role, text, key, fault, dropped, fresh))
            return out

        def table(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), arrow)], schema=arrow)

        for rb in batches:
            out = []
            for _, group in itertools.groupby(zip(*[c.to_pylist() for c in rb.columns]), key=lambda r: r[0]):
                group = list(group)
                if held and held[0][0] != group[0][0]:
                    # the task's first conversation may have begun in the range before
                    out += opened(held) if first else [(True, *whole(held[0][0], held), *[None] * 9)]
                    first, held = False, []
                held += group
            if out:
                yield table(out)
        if held:
            yield table(opened(held))

    return rows.mapInArrow(run, schema)


TABLE = "array<array<long>>"


def _tables(narrow: DataFrame, conv_type: str) -> DataFrame:
    """One row per piece: its costs and orders from state to state, and its counts."""
    schema = (f"conv {conv_type}, part int, live long, cost {TABLE}, rank {TABLE}, blank long, duplicate long, truncated long, illegal long, "
              "head int, tail int, low long, high long, turns long")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("seq")
        kinds, initials, turns = t["kind"].to_pylist(), t["initial"].to_pylist(), [x for x in t["turn"].to_pylist() if x is not None]
        faults, dup = t["fault"].to_pylist(), t["dup"].to_pylist()
        cost, rank = [], []
        for q in range(4):
            (c, r), total = over(start(q), kinds)
            cost.append([x + total if x < NONE else NONE for x in c])
            rank.append(list(r))
        row = (key[0].as_py(), key[1].as_py(), len(kinds), cost, rank, faults.count(1), sum(dup), sum(f == 2 and not d for f, d in zip(faults, dup)),
               sum(p not in LEGAL for p in itertools.pairwise(initials)), initials[0], initials[-1],
               turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)))
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow)], schema=arrow)

    arrow = _arrow(schema)
    return narrow.groupBy("conv", "part").applyInArrow(run, schema)


def _meet(tables: DataFrame, conv_type: str) -> DataFrame:
    """First and last state of each piece, and the conversation's counts on its first piece."""
    schema = (f"conv {conv_type}, part int, q0 int, q1 int, final boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long")

    def run(t: pa.Table) -> pa.Table:
        rows = t.sort_by("part").to_pylist()
        steps = [Step(r["cost"], r["rank"]) for r in rows]
        cost, last = solve(steps)
        states = [0, *borders(steps, 0, last)]
        dated = [r for r in rows if r["turns"]]
        gaps = (dated[-1]["high"] - dated[0]["low"] + 1 - sum(r["turns"] for r in dated)
                + sum(a["high"] == b["low"] for a, b in itertools.pairwise(dated))) if dated else 0
        illegal = sum(r["illegal"] for r in rows) + sum((a["tail"], b["head"]) not in LEGAL for a, b in itertools.pairwise(rows))
        sums = [gaps, *[sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated")], illegal, cost]
        out = [(r["conv"], r["part"], a, b, i == len(rows) - 1, *(sums if i == 0 else [None] * 6))
               for i, (r, a, b) in enumerate(zip(rows, states, states[1:]))]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    arrow = _arrow(schema)
    return tables.groupBy("conv").applyInArrow(run, schema)


def _piece_edits(narrow: DataFrame) -> DataFrame:
    """(part, seq, state before, edits) of the rows of pieces whose end states are fixed."""
    schema = "part int, seq long, q int, edits string"

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("seq")
        q0, q1, final = (t[c][0].as_py() for c in ("q0", "q1", "final"))
        q, e = map(list, zip(*edits(t["kind"].to_pylist(), q0, q1)))
        if final:
            e[-1] += TRAIL[q1]
        return pa.Table.from_arrays([t["part"], t["seq"], pa.array(q, pa.int32()), pa.array(e)], schema=arrow)

    arrow = _arrow(schema)
    return narrow.groupBy("conv", "part").applyInArrow(run, schema)


def _digest(rows: DataFrame, conv_type: str) -> DataFrame:
    """Audit and digest of each conversation from its rows in order; only the
    audit, which is the result, is held."""
    schema = f"conv {conv_type}, audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audit, sha, sep = None, [], None, b""

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((now[0], "".join(audit), sha.hexdigest()), arrow)], schema=arrow)

        for rb in batches:
            for conv, role, text, q, e in zip(*[c.to_pylist() for c in rb.columns]):
                if now is None or now[0] != conv:
                    if now:
                        yield done()
                    now, audit, sha, sep = (conv,), [], hashlib.sha256(), b""
                audit.append(e)
                for line in lines(q, e, role, text):
                    sha.update(sep + line.encode())
                    sep = b"\n"
        if now:
            yield done()

    arrow = _arrow(schema)
    return (rows.repartition("conv").sortWithinPartitions("conv", "part", "seq").select("conv", "role", "text", "q", "edits")
            .mapInArrow(run, schema))


def repair(df: DataFrame, damaged: bool = False, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256), one row per conversation. With ``damaged`` the rows are
    damaged first, by the contract's rule; otherwise they are repaired as they are."""
    spark = df.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/turns-{uuid.uuid4().hex}"
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"),
                     F.col(text_col).cast("string").alias("text"))
    rows = damage(rows) if damaged else rows.select("conv", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                                                    F.coalesce("text", F.lit(" ")).alias("text"), F.lit(False).alias("dropped"))
    conv_type = rows.schema["conv"].dataType.simpleString()
    size = rows.agg(F.sum(F.octet_length("text") + 64).alias("b")).first()["b"] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // piece_bytes))
    order = ["conv", "turn", "role", "key", "place"]  # null first
    dealt = (mark_faults(rows).withColumn("place", F.monotonically_increasing_id())
             .repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop("place"))
    made = _pieces(dealt, conv_type)
    made.write.parquet(f"{base}/pieces")
    made = spark.read.schema(made.schema).parquet(f"{base}/pieces")
    whole = made.filter("whole").select("conv", *[c.split()[0] for c in DONE.split(", ")])

    open_ = made.filter("not whole")
    live = open_.filter("not dropped")
    again = (live.filter("fresh").select("conv", "key", "part", "seq")
             .withColumn("n", F.row_number().over(Window.partitionBy("conv", "key").orderBy("part"))).filter("n > 1")
             .select("part", "seq", F.lit(True).alias("again")))
    initial = F.coalesce(*[F.when(F.col("role").startswith(k), v) for k, v in INITIAL.items()], F.lit(3))
    dup = (F.col("fault") != 1) & (~F.col("fresh") | F.col("again").isNotNull())
    narrow = (live.select("conv", "part", "seq", "turn", "role", "fault", "fresh").join(again, ["part", "seq"], "left")
              .select("conv", "part", "seq", "turn", initial.alias("initial"), "fault", dup.alias("dup")))
    narrow = narrow.withColumn("kind", F.when((F.col("fault") == 1) | F.col("dup"), DELETE_ONLY)
                               .otherwise(F.col("initial") + F.when(F.col("fault") == 2, 4).otherwise(0))).checkpoint()
    met = _meet(_tables(narrow, conv_type), conv_type).checkpoint()
    # a part has two pieces at most, and the conversations of both are known by their first row
    ways = met.select("part", "conv", "q0", "q1", "final")
    placed = narrow.alias("r").join(ways.alias("w"), (F.col("r.part") == F.col("w.part")) & F.col("r.conv").eqNullSafe(F.col("w.conv"))) \
                   .select("r.conv", "r.part", "r.seq", "r.kind", "w.q0", "w.q1", "w.final")
    texts = live.select("conv", "part", "seq", "role", "text").join(_piece_edits(placed), ["part", "seq"])
    sums = met.filter("cost is not null").select("conv", *[c.split()[0] for c in DONE.split(", ")[:6]])
    digests = _digest(texts, conv_type).withColumnRenamed("conv", "c")
    parted = sums.join(digests, sums["conv"].eqNullSafe(digests["c"])).drop("c")
    bare = open_.groupBy("conv").agg(F.min("dropped").alias("gone")).filter("gone").select(
        "conv", *[F.lit(0).cast("long").alias(c.split()[0]) for c in DONE.split(", ")[:6]], F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256"))
    return whole.unionByName(parted).unionByName(bare).withColumnRenamed("conv", conv_col)
