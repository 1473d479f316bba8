"""Conversation repair against exhaustive search and a plain shortest path."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
import xxhash

from tessera.llm import turns

SOLID = re.compile(r"[^\x20\x09-\x0D]")
SCHEMA = "conv_id long, turn long, role string, text string, part int, seq long, key long, dropped boolean"


def plain(rows, limit=3):
    """(cost, audit, lines) of (role, text, must go, truncated) rows: every way,
    kept by state as the least (cost, audit)."""
    ways = {"": (0, "", [])}  # by the last two initials

    def legal(state, c):
        return c in {"": "su", "s": "u", "u": "a", "a": "u"}[state]

    def offer(out, state, way):
        if state not in out or way[:2] < out[state][:2]:
            out[state] = way

    def inserts(ways):
        for _ in range(limit):
            for state, (cost, audit, out) in list(ways.items()):
                for role in ("user", "assistant"):
                    if legal(state, role[0]):
                        offer(ways, role[0], (cost + 5, audit + "I", out + [role + ":"]))
        return ways

    for role, text, gone, cut in rows:
        nxt = {}
        for state, (cost, audit, out) in inserts(ways).items():
            offer(nxt, state, (cost + 2, audit + "D", out))
            if gone:
                continue
            paid = cost + (5 if cut else 0)
            if role[:1] and legal(state, role[0]):
                offer(nxt, role[0], (paid, audit + "K", out + [f"{role}:{text}"]))
            for put in ("user", "assistant"):
                if legal(state, put[0]):
                    offer(nxt, put[0], (paid + 1, audit + "R", out + [f"{put}:{text}"]))
        ways = nxt
    return min(w for s, w in inserts(ways).items() if s in ("", "a"))


def exhaustive(rows):
    """The same from all edit sequences with up to two inserts in each gap."""
    best = None
    choices = [[p + e for p in itertools.chain.from_iterable(itertools.product("ua", repeat=n) for n in range(3))
                for e in ([("D",)] if gone else [("D",), ("K",), ("Ru",), ("Ra",)])] for _, _, gone, _ in rows]
    tails = list(itertools.chain.from_iterable(itertools.product("ua", repeat=n) for n in range(3)))
    for way in itertools.product(*choices, tails):
        cost, audit, roles = 0, "", ""
        for (role, _, gone, cut), edits in zip(list(rows) + [("", "", True, False)], way):
            for e in edits:
                if e in "ua":
                    cost, audit, roles = cost + 5, audit + "I", roles + e
                else:
                    audit += e[0]
                    if e != "D":
                        cost += (5 if cut else 0) + (e != "K")
                        roles += role[0] if e == "K" else e[1]
                    else:
                        cost += 2
        if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
            best = (cost, audit)
    return best


def test_row_tables_against_all_edits():
    rng = random.Random(3)
    for _ in range(60):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), "x", rng.random() < .15, rng.random() < .3) for _ in range(rng.randint(1, 3))]
        rows = [(r, t, g, c and not g) for r, t, g, c in rows]
        kinds = [turns._kind(r, 1 if g else 2 if c else 0, False) for r, _, g, c in rows]
        cost, last = turns.solve(kinds)
        audit = "".join(e for _, e in turns.edits(kinds, 0, last)) + turns.TRAIL[last]
        assert (cost, audit) == exhaustive(rows) == plain(rows)[:2]


def expected(rows, damaged=True):
    """Result by conversation of (conv_id, turn, role, text) rows, by plain code."""
    convs = {}
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        convs.setdefault(conv, []).extend([(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1))
    out = {}
    for conv, got in convs.items():
        h = lambda r: xxhash.xxh64_intdigest(r[2].encode(), xxhash.xxh64_intdigest(r[1].encode(), 42))
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], h(r) - (1 << 64) * (h(r) >> 63)))
        seen, faults, marked = set(), [0, 0, 0], []
        for turn, role, text in got:
            blank, dup = not SOLID.search(text), (role, text) in seen
            cut = not blank and not dup and SOLID.findall(text)[-1] not in ".!?"
            seen.add((role, text))
            for i, f in enumerate((blank, dup and not blank, cut)):
                faults[i] += f
            marked.append((role, text, blank or dup, cut))
        cost, audit, lines = plain(marked)
        known = [t for t, _, _ in got if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(got, got[1:]))
        out[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(df):
    got = df.collect()
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def rows_of(rng, conv, n):
    body = ["Yes.", "No!", "What then", "", " \t", "One. Two. Three", "é漢?", "Yes.", None]
    for i in range(n):
        yield (conv, rng.choice([i, i, i, i + 1, None]), rng.choice(["user", "assistant", "assistant", "system", "tool", "", None]),
               rng.choice(body) if rng.random() < .6 else f"Line {rng.randint(0, 99)}{rng.choice(['.', '', '!'])}")


@pytest.mark.parametrize("damaged", [True, False])
def test_whole_pieces_nulls_and_hot_conversations(spark, damaged):
    rng = random.Random(11)
    rows = [r for c in range(120) for r in rows_of(rng, c, rng.randint(1, 9))]
    rows += [r for c in (None, 500) for r in rows_of(rng, c, 700)]  # over many ranges
    rows += [(600, 1, "user", "Same.")] * 500 + [(None, None, None, None)] * 3 + [(601, None, "user", "Hi."), (602, 7, None, None)]
    df = spark.createDataFrame([(*r, 1, 2, 3, True) for r in rows], SCHEMA).repartition(5)
    want = expected(rows, damaged)
    if damaged:
        want |= {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in {r[0] for r in rows} - want.keys()}
    assert result(turns.repair(df, damaged, piece_bytes=4096)) == want


def test_conversation_without_rows_after_damage(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 0, "user", "Hi.")] * 40, "conv_id long, turn long, role string, text string")
    assert result(turns.repair(df, True, piece_bytes=64)) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_string_ids_long_texts_and_empty_table(spark):
    rows = [("a", 0, "user", "word " * 200_000 + "end."), ("a", 1, "assistant", "x" * 1_000_000), ("b", 0, "assistant", "Ok.")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    assert result(turns.repair(df, True)) == expected(rows)
    assert turns.repair(df.limit(0), True).count() == 0


def test_registered_query_against_plain_code(spark):
    from tessera.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = expected(rows)
    want |= {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in {r[0] for r in rows} - want.keys()}
    assert result(QUERIES["op13_turns"](spark, sf)) == want
