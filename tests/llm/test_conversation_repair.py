"""Conversation repair against the plain rule: all edits of all rows, by whole strings."""

import functools
import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from codeloom.llm import conversation_repair, repair_dp

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, letters string, n int, k long, part int"
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}


def cheapest(rows):
    """(cost, audit, turns) of (role, text, must go, cut) rows."""
    @functools.lru_cache(None)
    def best(i, state, filled):
        ways = [(0, "", ())] if i == len(rows) and state in (0, 3) else []

        def add(cost, letter, then, row, kept):
            if then is not None and (rest := best(row, then, 0 if row > i else filled + 1)):
                ways.append((cost + rest[0], letter + rest[1], kept + rest[2]))

        if i < len(rows):
            role, text, gone, cut = rows[i]
            add(2, "D", state, i + 1, ())
            if not gone:
                add(5 * cut, "K", NEXT.get(role[:1], {}).get(state), i + 1, ((role, text),))
                for to in ("user", "assistant"):
                    add(1 + 5 * cut, "R", NEXT[to[0]].get(state), i + 1, ((to, text),))
        if filled < 3:
            for to in ("user", "assistant"):
                add(5, "I", NEXT[to[0]].get(state), i, ((to, ""),))
        return min(ways) if ways else None

    return best(0, 0, 0)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        out += [(conv, turn, "user" if case == 4 else role, text)] * {0: 0, 3: 2}.get(case, 1)
    return out


def brute(rows, names):
    held, out = defaultdict(list), {}
    for conv, turn, role, text in rows:
        held[conv].append((turn is not None, turn or 0, " " if role is None else role, hashlib.sha256((" " if text is None else text).encode()).digest(), " " if text is None else text))
    for conv in names:
        mine, seen, seq = sorted(held[conv]), set(), []
        counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, _, text in mine:
            solid = re.findall("[^\x20\x09-\x0d]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            seq.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for timed, t, *_ in mine if timed]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, kept = cheapest(tuple(seq))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(), kept)
    return out


def check(df, wanted):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {df.schema[c].dataType.simpleString() for c in df.columns[:7]} == {"bigint"}
    rows = df.collect()
    assert len(rows) == len(wanted)
    for r in rows:
        assert tuple(r)[1:] == wanted[r[0]][:8], (r, wanted[r[0]])


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(conversation_repair.op11_conversation_repair(spark, SMALL), brute(damage(rows), {r[0] for r in rows}))


def random_rows(seed, number):
    draw = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "ufo"]
    texts = ["Yes.", "no", "", " \n", None, "So? ", "é!\t", "a" * 5000 + "."]
    return [(draw.choice([None, *range(number // 8)]), draw.choice([None, None, *range(-2, 12)]), draw.choices(roles, [6, 6, 2, 1, 1, 1, 1])[0], draw.choice([*texts, f"own {k}.", f"own {k}"])) for k in range(number)]


@pytest.mark.parametrize("size", [1 << 16, 3])
def test_hard_rows(spark, monkeypatch, size):
    """Nulls in all columns, empty and long texts, equal turns, repeated rows; conversations over blocks and tasks."""
    monkeypatch.setattr(repair_dp, "BLOCK", size)
    rows = random_rows(7, 300)
    rows += [(900, 1, "user", "Same.")] * 9 + [(901, None, "assistant", "a")] * 8
    rows += [(902, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(40)]
    df = spark.createDataFrame([(*r, "l", 1, 2, 3) for r in rows], SCHEMA).repartition(4)
    wanted = brute(rows, {r[0] for r in rows})
    check(conversation_repair.repair(df), wanted)
    turns = defaultdict(list)
    for r in conversation_repair.repaired_turns(df).collect():
        turns[r["conv_id"]].append((r["position"], r["role"], r["text"]))
    for conv, told in wanted.items():
        assert [x[1:] for x in sorted(turns[conv])] == list(told[8])
        assert [x[0] for x in sorted(turns[conv])] == list(range(len(told[8])))


def test_damage_on_hard_rows(spark):
    rows = random_rows(8, 400) + [(k, 0, "user", "Hi!") for k in range(1000, 1100)]  # some of these lose all rows
    df = spark.createDataFrame([(*r, "l", 1, 2, 3) for r in rows], SCHEMA)
    found = conversation_repair.repair(conversation_repair.damaged(df), copies="copies")
    wanted = brute(damage(rows), {r[0] for r in rows})
    assert any(not w[6] for w in wanted.values())
    check(found, wanted)


def test_empty_table_and_far_turns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversation_repair.repair(none).collect() == []
    assert conversation_repair.repaired_turns(none).collect() == []
    far = spark.createDataFrame([(1, -(1 << 63), "user", "A."), (1, (1 << 63) - 1, "assistant", "B.")], "conv_id long, turn long, role string, text string")
    assert conversation_repair.repair(far).first()["gaps"] == (1 << 63) - 1


def test_edits_of_random_rows_whole_and_in_blocks():
    draw = random.Random(1)
    for _ in range(1500):
        symbols = bytes(draw.choices(range(12), [2, 1, 1, 5, 1, 2, 5, 1, 2, 1, 1, 1], k=draw.randrange(14)))
        rows = tuple((("system", "user", "assistant", "tool")[s // 3], "t", s % 3 == 1, s % 3 == 2) for s in symbols)
        cost, audit, _ = cheapest(rows)
        assert repair_dp.repair(symbols) == (audit, cost)
        cuts = sorted(draw.sample(range(1, len(symbols)), 2)) if len(symbols) > 3 else [0, 0]
        blocks = [b for b in (symbols[: cuts[0]], symbols[cuts[0] : cuts[1]], symbols[cuts[1] :]) if b]
        state, letters, total = repair_dp.START, "", 0
        for block, behind in zip(blocks, repair_dp.vectors_behind([repair_dp.block_costs(b) for b in blocks])):
            some, state, paid = repair_dp.walk(block, behind, state)
            letters, total = letters + some, total + paid
        assert (letters + repair_dp.AT_END[state], total + repair_dp.END[state]) == (audit, cost)


def test_long_conversation_keeps_few_vectors():
    """As many letters as rows, and memory far below a vector for each row."""
    import tracemalloc

    symbols = bytes(random.Random(2).choices(range(12), k=200_000))
    tracemalloc.start()
    letters, _, _ = repair_dp.walk(symbols)
    assert tracemalloc.get_traced_memory()[1] < 40 * len(symbols)
    tracemalloc.stop()
    assert sum(letters.count(x) for x in "DKR") == len(symbols)
