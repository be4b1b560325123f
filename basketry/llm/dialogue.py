"""Conversation structure repair: the cheapest edits that turn the roles of a
conversation into an optional system turn and user-assistant pairs.

A conversation is read by four states: nothing said yet (0), after the system
turn (1), after a user (2), after an assistant (3); it may end in 0 or 3.
Each row is kept (K), gets another role (R), or is deleted (D), and turns may
be inserted (I) before it, so a row is a 4 x 4 table of costs from state to
state.  Blocks of rows, and blocks of blocks, are tables of the same form.

Hirschberg's divide and conquer: from the known state at the start a vector
of four costs runs forward to the middle, from the known state at the end one
runs backward; the state where their sum is least is the crossing, and both
halves are solved the same way.  Only vectors of four are held, never a
table of all rows.  Among equal crossings the one with the ASCII-least audit
is taken: the forward vector carries the rank of its four audits.  Ranks are
enough, because a crossing lies right after a row's own edit (inserts belong
to the row that follows), so none of two audits is the beginning of the other
and what follows cannot change their order.

Long conversations: rows are placed by a sample sort and cut into blocks of
``BLOCK`` rows; tables of blocks climb level by level, the states at their
borders come down again, so no task sees a whole long conversation before
its result is put together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import inf

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.ordinal import range_ordinal
from basketry.session import stage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5   # costs
ENDS = (0, 3)
BLOCK_BITS = 12            # rows of a block, blocks of a block: 4,096
COPIES = 4096              # equal rows that are numbered in one go
SPOKEN = "[^\\x20\\x09-\\x0D]"
INITIALS = "sua"           # other roles: code 3
BLANK, DUPLICATE, CUT = 1, 2, 3
Table = tuple[tuple[float, ...], tuple[int, ...]]   # 16 costs, 16 ranks (state before x state after)


# -- one row ----------------------------------------------------------------

def _next(state: int) -> int:
    """The state after an inserted or rerolled turn, whose role it fixes."""
    return 3 if state == 2 else 2


def _role(state_after: int) -> str:
    return "user" if state_after == 2 else "assistant"


def _kept(state: int, initial: int) -> int | None:
    if initial == 0:
        return 1 if state == 0 else None
    if initial in (1, 2) and _next(state) == initial + 1:
        return initial + 1
    return None


@lru_cache(None)
def row_edits(kind: int) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state after) -> (cost, audit) of a row; ``kind`` is the
    code of its role's initial plus four times its fault."""
    initial, fault = kind % 4, kind // 4
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for before in range(4):
        state, cost, audit = before, 0, ""
        for _ in range(4):  # up to three inserts; more would come round again
            ways = [(state, DELETE, "D")]
            if fault not in (BLANK, DUPLICATE):
                more = TRUNCATED if fault == CUT else 0
                ways.append((_next(state), REROLE + more, "R"))
                if (to := _kept(state, initial)) is not None:
                    ways.append((to, KEEP + more, "K"))
            for to, c, a in ways:
                one = (cost + c, audit + a)
                best[before, to] = min(best.get((before, to), one), one)
            state, cost, audit = _next(state), cost + INSERT, audit + "I"
    return best


@lru_cache(None)
def row_table(kind: int) -> Table:
    edits = row_edits(kind)
    costs, ranks = [], []
    for before in range(4):
        order = sorted((edits[before, to][1], to) for to in range(4) if (before, to) in edits)
        place = {to: i for i, (_, to) in enumerate(order)}
        costs += [float(edits[before, to][0]) if to in place else inf for to in range(4)]
        ranks += [place.get(to, 4) for to in range(4)]
    return tuple(costs), tuple(ranks)


def tail(state: int) -> tuple[int, str]:
    """The inserts that lead from a state to an end."""
    n = 0
    while state not in ENDS:
        state, n = _next(state), n + 1
    return n * INSERT, "I" * n


# -- vectors of four --------------------------------------------------------

def _start(state: int):
    return tuple(0.0 if s == state else inf for s in range(4)), tuple(0 if s == state else 4 for s in range(4))


@lru_cache(1 << 16)
def _ahead(vector, table: Table):
    """One table further: (cost taken out, (costs, ranks)).  Vectors are kept
    with least cost zero, so few differ and the cache answers most steps."""
    costs, ranks = vector
    t_cost, t_rank = table
    found = [min((costs[b] + t_cost[4 * b + to], ranks[b], t_rank[4 * b + to]) for b in range(4)) for to in range(4)]
    least = min(f[0] for f in found)
    order = sorted((f[1:], to) for to, f in enumerate(found) if f[0] < inf)
    place = {to: i for i, (_, to) in enumerate(order)}
    return least, (tuple(f[0] - least for f in found), tuple(place.get(to, 4) for to in range(4)))


@lru_cache(1 << 16)
def _behind(costs, table: Table):
    t_cost = table[0]
    found = [min(t_cost[4 * b + to] + costs[to] for to in range(4)) for b in range(4)]
    least = min(found)
    return (least, tuple(f - least for f in found)) if least < inf else (0.0, tuple(found))


def forward(tables: list[Table], lo: int, hi: int, state: int):
    """Costs and audit ranks of the four states after tables lo to hi."""
    total, vector = 0.0, _start(state)
    for i in range(lo, hi):
        least, vector = _ahead(vector, tables[i])
        total += least
    return [c + total for c in vector[0]], vector[1]


def backward(tables: list[Table], lo: int, hi: int, state: int) -> list[float]:
    """Costs from each of the four states before table lo to ``state``."""
    total, costs = 0.0, _start(state)[0]
    for i in range(hi - 1, lo - 1, -1):
        least, costs = _behind(costs, tables[i])
        total += least
    return [c + total for c in costs]


def crossings(tables: list[Table], first: int, last: int) -> list[int]:
    """The state at each border of the tables, both ends included."""
    states = [first] * len(tables) + [last]
    todo = [(0, len(tables), first, last)]
    while todo:
        lo, hi, p, q = todo.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        (ahead, ranks), behind = forward(tables, lo, mid, p), backward(tables, mid, hi, q)
        s = min(range(4), key=lambda s: (ahead[s] + behind[s], ranks[s]))
        states[mid] = s
        todo += [(lo, mid, p, s), (mid, hi, s, q)]
    return states


def block_table(tables: list[Table]) -> Table:
    costs, ranks = [], []
    for state in range(4):
        c, r = forward(tables, 0, len(tables), state)
        costs += c
        ranks += r
    return tuple(costs), tuple(ranks)


def last_state(table: Table) -> tuple[int, int]:
    """(state, cost) at the end of a whole conversation, audit-least."""
    cost, _, s = min((table[0][s] + tail(s)[0], table[1][s], s) for s in range(4))
    return s, int(cost)


def legal(a: int, b: int) -> bool:
    """Whether initials with codes a, b may follow each other: su, ua, au."""
    return (a, b) in ((0, 1), (1, 2), (2, 1))


# -- Spark ------------------------------------------------------------------

def _blank(c: Column) -> Column:
    return ~c.rlike(SPOKEN)


def damaged(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` with planted faults by
    crc32(``conv_id:turn``) modulo 20 (a null is one space): 0 drops the row,
    1 empties the text, 2 removes its ``.!?``, 3 repeats the row, 4 makes it a
    user's."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), hit.alias("hit")).filter("hit <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _faulted(distinct: DataFrame) -> DataFrame:
    """One row per row of the input with its ``kind``; ``distinct`` has equal
    rows once, with their number m."""
    seen = distinct.groupBy("conv", "said").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("f"))
    few = distinct.filter(F.col("m") <= COPIES).withColumn("piece", F.lit(0).cast("long"))
    many = (distinct.filter(F.col("m") > COPIES)
            .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(COPIES).cast("long"))))
            .repartition("conv", "said", "turn", "piece"))
    rows = few.unionByName(many).join(seen, ["conv", "said"])
    rows = rows.withColumn("copy", F.explode(F.sequence(F.col("piece"), F.least(F.col("piece") + COPIES, F.col("m")) - 1)))
    again = (F.col("copy") > 0) | ~F.col("turn").eqNullSafe(F.col("f.turn"))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = (F.when(_blank(F.col("text")), BLANK).when(again, DUPLICATE).when(last.isin(".", "!", "?"), 0).otherwise(CUT))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return rows.select("conv", "turn", "role", "text", "copy", (code + 4 * fault).cast("int").alias("kind"))


_TABLE = "conv string, block long, costs array<double>, ranks array<int>, first int, last int, illegal long"


def _row_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for conv, block, kinds in zip(b["conv"], b["block"], b["kinds"]):
            costs, ranks = block_table([row_table(int(k)) for k in kinds])
            ini = [int(k) % 4 for k in kinds]
            out.append((conv, block, list(costs), list(ranks), ini[0], ini[-1], sum(not legal(*p) for p in zip(ini, ini[1:]))))
        yield pd.DataFrame(out, columns=["conv", "block", "costs", "ranks", "first", "last", "illegal"])


def _tables(kids) -> list[Table]:
    return [(tuple(float(c) for c in k["costs"]), tuple(int(r) for r in k["ranks"])) for k in kids]


def _block_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for conv, block, kids in zip(b["conv"], b["block"], b["kids"]):
            costs, ranks = block_table(_tables(kids))
            bad = sum(int(k["illegal"]) for k in kids) + sum(not legal(x["last"], y["first"]) for x, y in zip(kids, kids[1:]))
            out.append((conv, block, list(costs), list(ranks), kids[0]["first"], kids[-1]["last"], bad))
        yield pd.DataFrame(out, columns=["conv", "block", "costs", "ranks", "first", "last", "illegal"])


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ends = [last_state((tuple(c), tuple(int(x) for x in r))) for c, r in zip(b["costs"], b["ranks"])]
        yield pd.DataFrame({"conv": b["conv"], "p": 0, "q": [e[0] for e in ends], "cost": [e[1] for e in ends], "illegal": b["illegal"]})


def _block_states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for conv, kids, p, q, is_last in zip(b["conv"], b["kids"], b["p"], b["q"], b["is_last"]):
            s = crossings(_tables(kids), p, q)
            out += [(conv, k["block"], s[i], s[i + 1], bool(is_last and i == len(kids) - 1)) for i, k in enumerate(kids)]
        yield pd.DataFrame(out, columns=["conv", "block", "p", "q", "is_last"])


def _row_states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for seqs, kinds, p, q, is_last in zip(b["seqs"], b["kinds"], b["p"], b["q"], b["is_last"]):
            s = crossings([row_table(int(k)) for k in kinds], p, q)
            for i, (seq, kind) in enumerate(zip(seqs, kinds)):
                audit = row_edits(int(kind))[s[i], s[i + 1]][1]
                ends = tail(s[i + 1])[1] if is_last and i == len(kinds) - 1 else ""
                state, put, role = s[i], [], None
                for a in audit[:-1] + ends:
                    if len(put) == len(audit) - 1:
                        state = s[i + 1]  # the inserts after the last row
                    state = _next(state)
                    put.append(_role(state))
                if audit[-1] == "R":
                    role = _role(s[i + 1])
                out.append((seq, audit + ends, put[:len(audit) - 1], role, put[len(audit) - 1:]))
        yield pd.DataFrame(out, columns=["seq", "audit", "before", "role_to", "after"])


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(turns, conversations).  Turns: conv_id, seq, part, edit (K, R or I),
    role, text of every repaired turn, in the order of (seq, part), and one
    row with edit D per deleted row; audit is the edits of its input row, on
    part 0.  Conversations: conv_id, gaps, blank, duplicate, truncated,
    illegal, cost.

    Null role and text: one space.  Null turn: before all others.  Rows of
    one turn: by role, then text.  Equal rows: one is the row, the others
    duplicates.  Null conv_id: a conversation of its own.  Empty table: no
    rows.  Other columns are not read.
    """
    at = lambda c: F.col(f"`{c}`")
    told = lambda c: F.coalesce(at(c).cast("string"), F.lit(" "))
    # a letter before the id: null joins like any other
    conv = F.coalesce(F.concat(F.lit("c"), at(conv_col).cast("string")), F.lit(""))
    kind_of_id = rows.select(at(conv_col).alias("x")).schema["x"].dataType
    rows = rows.select(conv.alias("conv"), at(turn_col).cast("long").alias("turn"), told(role_col).alias("role"), told(text_col).alias("text"))
    distinct = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("m"))
    distinct = stage(distinct.withColumn("said", F.sha2(F.concat("role", F.lit("\n"), "text"), 256)), "turns")
    placed = stage(range_ordinal(_faulted(distinct), ["conv", "turn", "role", "text", "copy"], "seq"), "placed")

    blocks = (placed.groupBy("conv", F.shiftright("seq", BLOCK_BITS).alias("block"))
              .agg(F.sort_array(F.collect_list(F.struct("seq", "kind"))).alias("x"))  # at most 4,096 rows
              .select("conv", "block", F.col("x.seq").alias("seqs"), F.col("x.kind").alias("kinds")))
    blocks = stage(blocks, "row-blocks")
    level = stage(blocks.select("conv", "block", "kinds").mapInPandas(_row_blocks, _TABLE), "tables")
    n, levels = placed.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] >> BLOCK_BITS, []
    while n:  # until every conversation is one block
        kid = F.struct("block", "costs", "ranks", "first", "last", "illegal")
        up = (level.groupBy("conv", F.shiftright("block", BLOCK_BITS).alias("up")).agg(F.sort_array(F.collect_list(kid)).alias("kids"))
              .select("conv", F.col("up").alias("block"), "kids"))
        levels.append(up := stage(up, "blocks"))
        level, n = stage(up.mapInPandas(_block_blocks, _TABLE), "tables"), n >> BLOCK_BITS
    whole = stage(level.mapInPandas(_whole, "conv string, p int, q int, cost long, illegal long"), "whole")
    states = whole.select("conv", F.lit(0).cast("long").alias("block"), "p", "q", F.lit(True).alias("is_last"))
    for up in reversed(levels):
        states = up.join(states, ["conv", "block"]).mapInPandas(
            _block_states, "conv string, block long, p int, q int, is_last boolean")
    edits = blocks.join(states, ["conv", "block"]).select("seqs", "kinds", "p", "q", "is_last").mapInPandas(
        _row_states, "seq long, audit string, before array<string>, role_to string, after array<string>")

    back = lambda: F.expr("substring(conv, 2)").cast(kind_of_id)
    real = F.when(F.col("conv") != "", back())
    put = lambda c: F.transform(c, lambda r: F.struct(F.lit("I").alias("edit"), r.alias("role"), F.lit("").alias("text")))
    own = F.struct(F.when(F.col("role_to").isNotNull(), "R").when(F.rtrim(F.col("audit"), F.lit("I")).endswith("K"), "K").otherwise("D").alias("edit"),
                   F.coalesce("role_to", "role").alias("role"), F.col("text").alias("text"))
    turns = (placed.join(edits, "seq")
             .select(real.alias("conv_id"), "seq", "audit", F.posexplode(F.concat(put("before"), F.array(own), put("after"))).alias("part", "x"))
             .select("conv_id", "seq", "part", F.when(F.col("part") == 0, F.col("audit")).alias("audit"), "x.*"))
    fault = F.expr("kind div 4")
    counts = placed.groupBy("conv").agg(*(F.count_if(fault == f).alias(name) for f, name in (
        (BLANK, "blank"), (DUPLICATE, "duplicate"), (CUT, "truncated"))))
    gaps = distinct.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    convs = (counts.join(gaps, "conv").join(whole.select("conv", "illegal", "cost"), "conv")
             .select(real.alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return turns, convs


def transcripts(turns: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired): the edits of each conversation in order,
    and its turns as ``role:text`` lines.  A conversation is one row here."""
    line = F.when(F.col("edit") != "D", F.concat("role", F.lit(":"), "text"))
    parts = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seq", "part", "audit", line.alias("line")))).alias("x"))
    return parts.select("conv_id", F.array_join("x.audit", "").alias("audit"), F.array_join("x.line", "\n").alias("repaired"))
