"""Repair of conversations to ``(system)? (user assistant)+`` by cheapest edits.

Narrow rows (key, turn, role, digest of the text) are merged with their copies, sorted over
ranges, and read as blocks of symbols. A conversation that lies within one task is solved
there. The others, long ones and those at the edges of tasks, are solved in blocks: a small
matrix of costs per block gives the costs behind each block, every block is then walked from all four
states, and the states are chained. So no conversation's rows meet for the edits.

The texts are shuffled once, sorted beside the blocks' letters, and read as a stream. A
conversation's digest is one sha256 over its texts in order, so one task reads them all; it holds
one row at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import repair_dp as dp
from codeloom.llm.common import over_arrow, staged, table
from codeloom.operators.skew import skew_join
from codeloom.session import ship_package

SPACE = " \t\n\x0b\x0c\r"
LEGAL = frozenset({"su", "ua", "au"})
_WHERE = ["unnamed", "k", "timed", "t", "role", "digest"]
_PLACE = "unnamed boolean, k long, timed boolean, t long, role string, digest binary, part int, seq int"
_STATS = ["blank", "duplicate", "truncated", "illegal", "turns"]
_TOLD = "blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first_role string, last_role string"
_BLOCK = f"{_PLACE}, whole boolean, n_rows long, letters string, cost long, {_TOLD}, symbols binary, costs array<long>"
_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TURNS = "conv_id long, position long, role string, text string"
_ROWS = 512  # rows of a batch that a task gives out
MOST_LONG = (1 << 63) - 1


def _prepared(rows: DataFrame, key: str, turn: str, role: str, text: str, copies: str | None) -> DataFrame:
    """Rows under own names; null keys and turns as a flag and 0, null roles and texts as one space."""
    number = F.coalesce(F.col(copies).cast("long"), F.lit(0)) if copies else F.lit(1).cast("long")
    content = F.coalesce(F.col(text), F.lit(" "))
    return rows.select(
        F.col(key).isNull().alias("unnamed"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("k"),
        F.col(turn).isNotNull().alias("timed"), F.coalesce(F.col(turn).cast("long"), F.lit(0)).alias("t"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"), content.alias("text"),
        F.unhex(F.sha2(content, 256)).alias("digest"), number.alias("copies"),
    )


def marked(rows: DataFrame) -> DataFrame:
    """Distinct rows by place with their number and faults; the same role and text at an earlier turn is ``again``."""
    shown = F.rtrim("text", F.lit(SPACE))
    faults = {"is_blank": shown == "", "is_cut": ~F.right(shown, F.lit(1)).isin(".", "!", "?")}
    merged = rows.withColumns(faults).groupBy(*_WHERE).agg(F.sum("copies").alias("n"), F.first("is_blank").alias("is_blank"), F.first("is_cut").alias("is_cut"))
    merged = staged(merged, "turns")
    said = ["unnamed", "k", "role", "digest"]
    first = merged.where("n > 0").groupBy(*said).agg(F.min(F.struct("timed", "t")).alias("first"), F.count(F.lit(1)).alias("places")).where("places > 1")
    found = skew_join(merged, first.select(*said, "first"), said, spread_by=["timed", "t"])
    return staged(found.withColumn("again", F.coalesce(F.struct("timed", "t") > F.col("first"), F.lit(False))).drop("first"), "marked")


class _Block:
    """Rows of one conversation that follow each other in one task."""

    def __init__(self, row: tuple, seq: int) -> None:
        self.place, self.seq = row[:6], seq
        self.symbols = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.first_role = self.last_role = None

    def add(self, timed: bool, turn: int, role: str, copies: int, blank: bool, cut: bool, again: bool) -> None:
        kind = dp.role_of(role[:1])
        fault = dp.MUST_GO if blank or again else dp.ENDS_EARLY if cut else dp.SOUND
        self.symbols.append(dp.symbol(kind, fault))
        self.symbols += bytes([dp.symbol(kind, dp.MUST_GO)]) * (copies - 1)
        if blank:
            self.blank += copies
        else:
            self.duplicate += copies - 1 + again
            self.truncated += cut and not again
        if self.last_role is not None:
            self.illegal += self.last_role + role[:1] not in LEGAL
        self.illegal += copies - 1  # no role may follow itself
        self.last_role = role[:1]
        if self.first_role is None:
            self.first_role = self.last_role
        if timed and turn != self.last_turn:
            self.turns += 1
            self.last_turn = turn
            if self.first_turn is None:
                self.first_turn = turn

    def row(self, part: int, whole: bool) -> tuple:
        symbols = bytes(self.symbols)
        letters, cost = dp.repair(symbols) if whole else (None, None)
        told = (self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.first_turn, self.last_turn, self.first_role, self.last_role)
        costs = None if whole or not symbols else dp.block_costs(symbols).ravel().tolist()
        return (*self.place, part, self.seq, whole, len(symbols), letters, cost, *told, None if whole else symbols, costs)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == _ROWS:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _arrow(schema: str) -> pa.Schema:
    """Arrow schema of a flat DDL string."""
    kinds = {"boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in schema.split(", "))])


def edit_blocks(turns: DataFrame) -> DataFrame:
    """Blocks in order of ``part, seq``, with letters where the whole conversation lies in the task."""
    size = dp.BLOCK

    def found(batches) -> Iterator[tuple]:
        part, seq, edge, block, parts = TaskContext.get().partitionId(), 0, True, None, 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in [*_WHERE, "n", "is_blank", "is_cut", "again"]), strict=True):
                if block is not None and block.place[:2] != row[:2]:
                    yield block.row(part, not edge and not parts)
                    seq, edge, block, parts = seq + 1, False, None, 0
                left, again = row[6], row[9]
                while True:
                    if block is not None and len(block.symbols) >= size:
                        yield block.row(part, False)
                        seq, parts, block = seq + 1, parts + 1, None
                    if block is None:
                        block = _Block(row, seq)
                    if left <= 0:
                        break
                    some = min(left, size - len(block.symbols))
                    block.add(row[2], row[3], row[4], some, row[7], row[8], again)
                    left, again = left - some, True
                    if left <= 0:
                        break
        if block is not None:
            yield block.row(part, False)  # the next task may go on with it

    dealt = turns.repartitionByRange(*_WHERE).sortWithinPartitions(*_WHERE)
    return staged(over_arrow(dealt, lambda batches: _batches(found(batches), _arrow(_BLOCK)), _BLOCK), "blocks")


def _by_conversation(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on the blocks of a conversation, one row for each ``BLOCK`` of its rows."""
    ship_package(rows.sparkSession)
    return rows.groupBy("unnamed", "k").applyInPandas(lambda pdf: work(pdf.sort_values(["part", "seq"])), schema)


def _behind(pdf: pd.DataFrame) -> pd.DataFrame:
    empty = np.where(np.eye(4, dtype=bool), 0, 1 << 40)
    costs = [np.array(c, np.int64).reshape(4, 4) if c is not None else empty for c in pdf["costs"]]
    return pd.DataFrame({"part": pdf["part"], "seq": pdf["seq"], "after": [list(v) for v in dp.vectors_behind(costs)]})


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state each block begins in; counts and costs of the conversation in its first block."""
    state, begins, total = dp.START, [], 0
    for ends, costs in zip(pdf["ends"], pdf["paid"], strict=True):
        begins.append(state)
        total += int(costs[state])
        state = int(ends[state])
    out = pdf[["part", "seq"]].copy()
    out["state"] = begins
    out["tail"] = ["" for _ in begins[1:]] + [dp.AT_END[state]]
    sums = {c: int(pdf[c].sum()) for c in _STATS}
    turn = role = None
    for a, b, x, y in zip(pdf["first_turn"], pdf["last_turn"], pdf["first_role"], pdf["last_role"], strict=True):
        if not pd.isna(a):
            sums["turns"] -= turn is not None and int(a) == turn  # one turn over two blocks
            turn = int(b)
        if x is not None:
            sums["illegal"] += role is not None and role + x not in LEGAL
            role = y
    timed = pdf[pdf["first_turn"].notna()]
    sums |= {"cost": total + dp.END[state], "first_turn": int(timed["first_turn"].iloc[0]) if len(timed) else None, "last_turn": int(timed["last_turn"].iloc[-1]) if len(timed) else None}
    for name, value in sums.items():
        out[name] = pd.array([value if value is not None else pd.NA, *[pd.NA] * (len(out) - 1)], "Int64")
    return out


def _solved(blocks: DataFrame) -> DataFrame:
    """(place, letters, counts): the blocks of conversations over several tasks or blocks, in three passes."""
    after = _by_conversation(blocks.select("unnamed", "k", "part", "seq", "costs"), _behind, "part int, seq int, after array<long>")
    names = ["ends", "paid", "ways"]

    def walks(batches):
        for batch in batches:
            found = []
            for symbols, vector in zip(batch.column("symbols").to_pylist(), batch.column("after").to_pylist(), strict=True):
                ways = [dp.walk(symbols, tuple(vector), state) for state in dp.STATES]
                found.append(([w[1] for w in ways], [w[2] for w in ways], [w[0] for w in ways]))
            kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
            more = [pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), kinds, strict=True)] if found else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    joined = blocks.drop("letters", "cost", "costs").join(after, ["part", "seq"])
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in joined.schema.fields]
    walked = staged(over_arrow(joined, walks, ", ".join([*kept, "ends array<long>", "paid array<long>", "ways array<string>"])), "walked")
    told = ["blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "first_role", "last_role"]
    chained = _by_conversation(walked.select("unnamed", "k", "part", "seq", "ends", "paid", *told), _chain,
                               "part int, seq int, state int, tail string, blank long, duplicate long, truncated long, illegal long, turns long, cost long, first_turn long, last_turn long")
    out = walked.select(*_WHERE, "part", "seq", "ways").join(chained, ["part", "seq"])
    return out.withColumn("letters", F.concat(F.get("ways", "state"), "tail")).drop("ways", "state", "tail")


class _Open:
    """A conversation whose letters and texts stream by."""

    def __init__(self, row: tuple) -> None:
        self.name = row[:2]
        self.letters: list[str] = []
        self.at = self.pos = 0  # next letter: which string, where in it
        self.counts: tuple | None = None
        self.state, self.seen, self.used, self.position = dp.START, None, 0, 0
        self.hash = hashlib.sha256()

    def letter(self) -> str | None:
        while self.at < len(self.letters) and self.pos == len(self.letters[self.at]):
            self.at, self.pos = self.at + 1, 0
        if self.at == len(self.letters):
            return None
        self.pos += 1
        return self.letters[self.at][self.pos - 1]

    def turn(self, role: str, text: str) -> tuple[int, str, str]:
        self.hash.update((("\n" if self.position else "") + role + ":" + text).encode())
        self.position += 1
        return self.position - 1, role, text

    def fill(self, text: str = "") -> tuple[int, str, str]:
        role, self.state = dp.FILLER[self.state], dp.FILLED[self.state]
        return self.turn(role, text)

    def edit(self, role: str, text: str) -> Iterator[tuple[int, str, str]]:
        """The turns that the next letters make of a row."""
        while (letter := self.letter()) == "I":
            yield self.fill()
        if letter == "K":
            self.state = dp._KEPT[dp.role_of(role[:1])][self.state]
            yield self.turn(role, text)
        elif letter == "R":
            yield self.fill(text)

    def rest(self) -> Iterator[tuple[int, str, str]]:
        while self.letter() is not None:
            yield self.fill()

    def report(self) -> tuple:
        blank, duplicate, truncated, illegal, turns, first, last, cost = self.counts
        gaps = 0 if first is None else min(last - first + 1 - turns, MOST_LONG)
        key = None if self.name[0] else self.name[1]
        return key, gaps, blank, duplicate, truncated, illegal, cost, "".join(self.letters), self.hash.hexdigest()


def _streamed(rows: DataFrame, blocks: DataFrame, as_turns: bool) -> DataFrame:
    """Letters and texts side by side in order: reports, or the repaired turns."""
    counts = ["blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "cost"]
    texts = rows.where("copies > 0").select(*_WHERE, F.lit(1).alias("kind"), F.lit(0).alias("part"), F.lit(0).alias("seq"), F.col("text").alias("held"), "copies", *[F.lit(None).cast("long").alias(c) for c in counts])
    heads = blocks.select(*_WHERE, F.lit(0).alias("kind"), "part", "seq", F.col("letters").alias("held"), F.lit(0).cast("long").alias("copies"), *counts)
    both = heads.unionByName(texts).repartition("unnamed", "k").sortWithinPartitions(*_WHERE, "kind", "part", "seq")

    def found(batches) -> Iterator[tuple]:
        open_: _Open | None = None

        def close():
            key = None if open_.name[0] else open_.name[1]
            for turn in open_.rest():
                if as_turns:
                    yield key, *turn
            if not as_turns:
                yield open_.report()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in [*_WHERE, "kind", "held", "copies", *counts]), strict=True):
                if open_ is None or open_.name != row[:2]:
                    if open_ is not None:
                        yield from close()
                    open_ = _Open(row)
                if row[6] == 0:
                    open_.letters.append(row[7])
                    if row[16] is not None:
                        open_.counts = row[9:17]
                    continue
                for _ in range(row[8]):
                    for turn in open_.edit(row[4], row[7]):
                        if as_turns:
                            yield row[1] if not row[0] else None, *turn
        if open_ is not None:
            yield from close()

    schema = _TURNS if as_turns else _REPORT
    return over_arrow(both, lambda batches: _batches(found(batches), _arrow(schema)), schema)


def _solve(rows: DataFrame, as_turns: bool) -> DataFrame:
    blocks = edit_blocks(marked(rows))
    names = [*_WHERE, "part", "seq", "letters", "blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "cost"]
    whole = blocks.where("whole").select(*names)
    return _streamed(rows, whole.unionByName(staged(_solved(blocks.where("not whole")).select(*names), "solved")), as_turns)


def repair(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Rows stand in the order of turn (null first), role, and sha256 of the text. ``copies`` may name a column
    with how often a row stands there; rows with 0 name their conversation only. Repeated rows
    stand beside each other, and all but the first are duplicates (or blank). Null roles and texts are one
    space; a role that begins with no s, u or a cannot be kept, an empty one neither. Null
    keys are one conversation. No rows: zeros, an empty audit, the hash of nothing. An empty table gives
    no rows. Gaps beyond a long are the largest long. Other columns are not read.
    """
    return _solve(_prepared(rows, key, turn, role, text, copies), False)


def repaired_turns(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None) -> DataFrame:
    """(conv_id, position, role, text): the turns of all conversations after the edits of ``repair``."""
    return _solve(_prepared(rows, key, turn, role, text, copies), True)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with the faults that the checksum of ``conv_id:turn`` names, and how often each stands there."""
    def told(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    case = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    return rows.select("conv_id", "turn", F.when(case == 4, "user").otherwise(told("role")).alias("role"), text.alias("text"), F.when(case == 0, 0).when(case == 3, 2).otherwise(1).alias("copies"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")), copies="copies")
