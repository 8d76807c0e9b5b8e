r"""The cheapest edits that make conversations well formed, by a rank-compressed dynamic program.

A conversation's roles, by their first letters, must read (s?(ua)+)?. Edits of a turn: Keep (0), Rerole to user or assistant
(RE_ROLE), Delete (DELETE; blank and duplicate turns must go); turns without text may be Inserted anywhere (INSERT), and a
truncated turn that stays costs TRUNCATED more. Of equally cheap edits those whose letters K, R, D, I read least in ASCII
are taken. A kept letter decides which roles the others get, so the letters alone decide the repair.

A macro edit is a run of inserts with the turn's own edit after it. Its letters end at the first that isn't I, so no macro
edit begins another, and after equally many turns neither do the letters of two states. They are compared, therefore, by
their states' ranks after the turn before and then by the place of the macro edit among all nine: a layer keeps a cost, a
rank and a pointer for each of four states (nothing yet; after s, u, a), never letters, which are read back from the
pointers at the end. Costs count from the layer's least, so few layers exist and each is made once and remembered.

Turns are sorted in ranges, so that a conversation may lie in many tasks. A task repairs those that lie within it as they
pass. What reaches to a range's end goes on as segments: a segment gives, for each state before it, the states after it with
cost and rank; those of a conversation are joined in order (a row per segment), and each segment then reads its own edits.
Turns seen in an earlier segment are found by their digests. Results of such a conversation come in parts.

Order: turn (nulls first), then role and text in UTF-8 order. Rows that repeat an id and turn are turns of their own, equal
ones being duplicates. Null roles and texts count as one space; rows with a null conv_id are one conversation. A role
without letters of these counts as illegal wherever it stands. Long texts are taken whole. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewright.llm.common import bound_batches, checked, materialize

RE_ROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after s, after u, after a. What a letter leads to, and what an insert does.
START, S, U, A = range(4)
STEPS = {START: {"s": S, "u": U}, S: {"u": U}, U: {"a": A}, A: {"u": U}}
INSERTED = {START: U, S: U, U: A, A: U}
ROLES = {U: "user", A: "assistant"}
#: Macro edits in ASCII order; longer runs of inserts come back to the same states at a higher cost.
MACROS = sorted("I" * n + edit for n in range(3) for edit in "KRD")
#: Inserts that end a conversation well from each state.
TAILS = {START: "", S: "II", U: "I", A: ""}
LEGAL = {"su", "ua", "au"}
SOLID, CLOSED = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"[.!?][\x20\x09-\x0D]*\Z")


@lru_cache(maxsize=None)
def moves(letter: str, must_go: bool, truncated: bool) -> list[list[tuple[int, int, int]]]:
    """For each state before a turn: (state after, cost, place of the macro edit)."""
    out = []
    for state in range(4):
        found = []
        for place, macro in enumerate(MACROS):
            at, cost = state, INSERT * (len(macro) - 1)
            for _ in macro[:-1]:
                at = INSERTED[at]
            if macro[-1] == "D":
                found.append((at, cost + DELETE, place))
                continue
            if must_go:
                continue
            cost += TRUNCATED if truncated else 0
            if macro[-1] == "K":
                if letter in STEPS[at]:
                    found.append((STEPS[at][letter], cost, place))
            else:
                found.append((STEPS[at]["a" if at == U else "u"], cost + RE_ROLE, place))
        out.append(found)
    return out


#: A layer: for each state its cost above the least and its rank, or None where it can't be reached.
Layer = tuple[tuple[int, int] | None, ...]


@lru_cache(maxsize=1 << 16)
def advance(layer: Layer, letter: str, must_go: bool, truncated: bool) -> tuple[Layer, int, tuple]:
    """The layer after a turn, the least cost added, and each state's pointer (state before, macro edit)."""
    best: list[tuple[int, int, int, int] | None] = [None] * 4
    for before, found in zip(range(4), moves(letter, must_go, truncated), strict=True):
        if layer[before] is not None:
            cost, rank = layer[before]
            for after, more, place in found:
                new = (cost + more, rank, place, before)
                if best[after] is None or new < best[after]:
                    best[after] = new
    least = min(b[0] for b in best if b is not None)
    ranks = {s: r for r, (_, s) in enumerate(sorted((b[1:3], s) for s, b in enumerate(best) if b is not None))}
    return tuple((b[0] - least, ranks[s]) if b is not None else None for s, b in enumerate(best)), least, tuple((b[3], b[2]) if b is not None else None for b in best)


def only(state: int) -> Layer:
    return tuple((0, 0) if s == state else None for s in range(4))


def walk(kinds: list[tuple[str, bool, bool]], layer: Layer) -> tuple[Layer, int, list]:
    """The last layer of turns, its least cost, and all pointers."""
    base, pointers = 0, []
    for kind in kinds:
        layer, more, back = advance(layer, *kind)
        base += more
        pointers.append(back)
    return layer, base, pointers


def read_back(pointers: list, state: int) -> list[str]:
    """The macro edits that lead to a state."""
    out = []
    for back in reversed(pointers):
        state, place = back[state]
        out.append(MACROS[place])
    return out[::-1]


def finish(layer: Layer) -> int:
    """The state from which the end is reached at the least cost with the least letters."""
    return min((layer[s][0] + INSERT * len(TAILS[s]), layer[s][1], s) for s in range(4) if layer[s] is not None)[2]


def repaired(turns: list[tuple[str, str]], macros: list[str], state: int, tail: str) -> list[dict]:
    """Roles and texts after the edits."""
    out = []

    def insert(n: int) -> None:
        nonlocal state
        for _ in range(n):
            state = INSERTED[state]
            out.append({"role": ROLES[state], "text": ""})

    for (role, text), macro in zip(turns, macros, strict=True):
        insert(len(macro) - 1)
        if macro[-1] == "K":
            state = STEPS[state][role[0]]
            out.append({"role": role, "text": text})
        elif macro[-1] == "R":
            state = A if state == U else U
            out.append({"role": ROLES[state], "text": text})
    insert(len(tail))
    return out


def kind_of(role: str, text: str, seen: bool) -> tuple[str, bool, bool, str]:
    """What the program needs of a turn, and the name of its first fault."""
    fault = "blank" if not SOLID.search(text) else "duplicate" if seen else "" if CLOSED.search(text) else "truncated"
    letter = role[0] if role and role[0] in "sua" else ""
    return letter, fault in ("blank", "duplicate"), fault == "truncated", fault


class Facts:
    """Counts of a run of turns in order; add() and join() keep what both sides need."""

    FIELDS = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last")

    def __init__(self, values: tuple = (0, 0, 0, 0, 0, None, None, None, None)):
        self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.low, self.high, self.first, self.last = values

    def values(self) -> tuple:
        return tuple(getattr(self, f) for f in self.FIELDS)

    def add(self, turn: int | None, letter: str, fault: str) -> None:
        self.join(Facts((fault == "blank", fault == "duplicate", fault == "truncated", 0, int(turn is not None), turn, turn, letter, letter)))

    def join(self, later: Facts) -> None:
        for f in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, f, getattr(self, f) + getattr(later, f))
        if later.low is not None:
            self.turns -= self.high == later.low
            self.low, self.high = later.low if self.low is None else self.low, later.high
        if later.first is not None:
            self.illegal += self.last is not None and self.last + later.first not in LEGAL
            self.first, self.last = later.first if self.first is None else self.first, later.last

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


REPORT = "conv_id bigint, part int, parts int, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, turns array<struct<role:string,text:string>>"
OPEN = "range int, place int, turn bigint, role string, text string, present boolean, digest binary"
TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
KINDS = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 6, pa.string(), TURNS]
NAMES = ["conv_id", "part", "parts", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "turns"]
OPEN_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.binary()]
OPEN_NAMES = ["range", "place", "turn", "role", "text", "present", "digest"]
#: Turns of repaired conversations that a worker gathers before it hands them on.
HELD = 5_000


def digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


def repair_whole(conv_id: int | None, rows: list[tuple]) -> tuple:
    """A conversation's row of REPORT; rows: turn, role, text, present, in order."""
    facts, kinds, turns, seen = Facts(), [], [], set()
    for turn, role, text, present in rows:
        if not present:
            continue
        key = digest(role, text)
        letter, must_go, truncated, fault = kind_of(role, text, key in seen)
        seen.add(key)
        facts.add(turn, letter or "-", fault)
        kinds.append((letter, must_go, truncated))
        turns.append((role, text))
    layer, cost, pointers = walk(kinds, only(START))
    end = finish(layer)
    macros, tail = read_back(pointers, end), TAILS[end]
    return conv_id, 0, 1, facts.gaps(), facts.blank, facts.duplicate, facts.truncated, facts.illegal, cost + layer[end][0] + INSERT * len(tail), "".join(macros) + tail, repaired(turns, macros, START, tail)


def _sorted_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repairs the conversations within a range, and gives the turns of its first and last one, which may reach beyond it."""
    part = TaskContext.get().partitionId()
    own, rows, first, done, held = None, [], True, [], 0

    def out(done: list[tuple], open_rows: list[tuple], conv_id: int | None) -> Iterator[pa.RecordBatch]:
        if done:
            yield pa.RecordBatch.from_arrays([*(pa.array(list(c), k) for c, k in zip(zip(*done, strict=True), KINDS, strict=True)), *(pa.nulls(len(done), k) for k in OPEN_KINDS)], [*NAMES, *OPEN_NAMES])
        for lo in range(0, len(open_rows), HELD):
            piece = [(part, lo + k, *row, digest(row[1], row[2])) for k, row in enumerate(open_rows[lo : lo + HELD])]
            yield pa.RecordBatch.from_arrays([pa.array([conv_id] * len(piece), pa.int64()), *(pa.nulls(len(piece), k) for k in KINDS[1:]), *(pa.array(list(c), k) for c, k in zip(zip(*piece, strict=True), OPEN_KINDS, strict=True))], [*NAMES, *OPEN_NAMES])

    for batch in batches:
        for conv_id, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and conv_id != own:
                if first:
                    yield from out([], rows, own)
                    first = False
                else:
                    done.append(repair_whole(own, rows))
                    held += len(rows)
                    if held >= HELD:
                        yield from out(done, [], None)
                        done, held = [], 0
                rows = []
            own = conv_id
            rows.append(tuple(row))
    yield from out(done, [], None)
    if rows:
        yield from out([], rows, own)


def _segment_kinds(pdf: pd.DataFrame) -> tuple[Facts, list, list]:
    facts, kinds, turns = Facts(), [], []
    pdf = pdf[pdf["present"].astype(bool)].sort_values("place")
    for turn, role, text, seen in zip(pdf["turn"], pdf["role"], pdf["text"], pdf["seen"], strict=True):
        letter, must_go, truncated, fault = kind_of(role, text, bool(seen))
        facts.add(None if turn is None else int(turn), letter or "-", fault)
        kinds.append((letter, must_go, truncated))
        turns.append((role, text))
    return facts, kinds, turns


SEGMENT = "conv_id bigint, range int, costs array<array<bigint>>, ranks array<array<int>>, facts array<string>, first string, last string"


def _summary(pdf: pd.DataFrame) -> pd.DataFrame:
    """A segment's costs and ranks from each state before it to each after it (null where there is no way), and its facts."""
    facts, kinds, _ = _segment_kinds(pdf)
    costs, ranks = [], []
    for before in range(4):
        layer, base, _ = walk(kinds, only(before))
        costs.append([None if x is None else base + x[0] for x in layer])
        ranks.append([None if x is None else x[1] for x in layer])
    *numbers, first, last = facts.values()
    return pd.DataFrame({"conv_id": [pdf["conv_id"].iloc[0]], "range": [pdf["range"].iloc[0]], "costs": [costs], "ranks": [ranks], "facts": [[None if x is None else str(x) for x in numbers]], "first": [first], "last": [last]}).astype({"conv_id": "Int64"})


PLAN = "conv_id bigint, range int, part int, parts int, before int, after int, last boolean, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """A conversation's segments, a row each, joined in order: the states between them on the cheapest way, and all counts."""
    pdf = pdf.sort_values("range", ignore_index=True)
    facts, layer, pointers = Facts(), {START: (0, 0)}, []
    number = lambda x: None if pd.isna(x) else int(x)
    for costs, ranks, own, first, last in zip(pdf["costs"], pdf["ranks"], pdf["facts"], pdf["first"], pdf["last"], strict=True):
        facts.join(Facts((*[number(x) for x in own], first, last)))
        best: dict[int, tuple] = {}
        for before, (cost, rank) in layer.items():
            for after in range(4):
                more = number(costs[before][after])
                if more is not None:
                    new = (cost + more, rank, number(ranks[before][after]), before)
                    if after not in best or new < best[after]:
                        best[after] = new
        order = {s: r for r, (_, s) in enumerate(sorted((b[1:3], s) for s, b in best.items()))}
        layer = {s: (b[0], order[s]) for s, b in best.items()}
        pointers.append({s: b[3] for s, b in best.items()})
    end = finish(tuple(layer.get(s) for s in range(4)))
    cost, states = layer[end][0] + INSERT * len(TAILS[end]), [end]
    for back in reversed(pointers):
        states.append(back[states[-1]])
    states = states[::-1]
    n = len(pdf)
    fixed = {"gaps": facts.gaps(), "blank": facts.blank, "duplicate": facts.duplicate, "truncated": facts.truncated, "illegal": facts.illegal, "cost": cost}
    out = pd.DataFrame({"conv_id": pdf["conv_id"].astype("Int64"), "range": pdf["range"], "part": range(n), "parts": n, "before": states[:-1], "after": states[1:], "last": [k == n - 1 for k in range(n)]})
    return out.assign(**fixed)


def _segment(pdf: pd.DataFrame) -> pd.DataFrame:
    """A segment's part of its conversation's repair, from the state before it to that after it."""
    plan = pdf.iloc[0]
    _, kinds, turns = _segment_kinds(pdf)
    _, _, pointers = walk(kinds, only(int(plan["before"])))
    macros, tail = read_back(pointers, int(plan["after"])), TAILS[int(plan["after"])] if plan["last"] else ""
    out = {c: [plan[c]] for c in NAMES[:-2]} | {"audit": ["".join(macros) + tail], "turns": [repaired(turns, macros, int(plan["before"]), tail)]}
    return pd.DataFrame(out).astype({"conv_id": "Int64"})


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None) -> DataFrame:
    """Per conversation and part: conv_id, part (from 0), parts, gaps, blank, duplicate, truncated, illegal, cost (of the whole), and the part's audit and turns (role, text).

    Rows where present is false keep their conversation in the result and are otherwise left out.
    """
    spark = conversations.sparkSession
    bound_batches(spark)
    space = lambda c: F.coalesce(conversations[c].cast("string"), F.lit(" "))
    rows = conversations.select(conversations[conv_col].cast("long").alias("conv_id"), conversations[turn_col].cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(ranges, "conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    found = materialize(ordered.mapInArrow(_sorted_ranges, f"{REPORT}, {OPEN}"), "conversations")
    whole = found.where("range is null").select(*NAMES)
    rest = found.where("range is not null").select("conv_id", *OPEN_NAMES)
    # Of equal turns in one conversation the first stays; a key is met with its first place, never with the others.
    same = F.col("f.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("f.digest") == F.col("r.digest"))
    firsts = rest.where("present").groupBy("conv_id", "digest").agg(F.min(F.struct("range", "place")).alias("at"), F.count("*").alias("n")).where("n > 1")
    rest = rest.alias("r").join(firsts.alias("f"), same, "left").select("r.*", F.coalesce(F.struct("range", "place") > F.col("at"), F.lit(False)).alias("seen"))
    rest = materialize(rest.drop("digest").withColumn("turn", F.col("turn").cast("string")), "conversation-segments")
    segments = rest.groupBy("conv_id", "range").applyInPandas(_summary, SEGMENT)
    plan = materialize(segments.groupBy("conv_id").applyInPandas(_plan, PLAN), "conversation-plan")
    own = rest.alias("r").join(checked(plan).alias("p"), F.col("r.conv_id").eqNullSafe(F.col("p.conv_id")) & (F.col("r.range") == F.col("p.range")))
    own = own.select("r.*", *[f"p.{c}" for c in ("part", "parts", "before", "after", "last", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")])
    return whole.unionByName(own.groupBy("conv_id", "range").applyInPandas(_segment, REPORT))


def _digest_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id and digest of conversations whose parts come in order, one batch at a time."""
    own, hashed, any_text, seen, audits = None, None, False, False, []
    kinds, names = [pa.int64(), pa.string(), pa.string()], ["conv_id", "audit", "repaired_sha256"]
    give = lambda: pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((own, "".join(audits), hashed.hexdigest()), kinds, strict=True)], names)
    for batch in batches:
        for row in batch.to_pylist():
            if not seen or row["conv_id"] != own:
                if seen:
                    yield give()
                own, hashed, any_text, seen, audits = row["conv_id"], hashlib.sha256(), False, True, []
            audits.append(row["audit"])
            for turn in row["turns"]:
                hashed.update((("\n" if any_text else "") + f"{turn['role']}:{turn['text']}").encode())
                any_text = True
    if seen:
        yield give()


def digests(report: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, the counts, cost, audit, and repaired_sha256 of its repaired turns, a line each."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    whole = report.where("parts = 1").select("conv_id", *counts, "audit", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
    many = report.where("parts > 1")
    hashed = many.select("conv_id", "part", "audit", "turns").repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "audit", "turns").mapInArrow(_digest_parts, "conv_id bigint, audit string, repaired_sha256 string")
    heads = many.where("part = 0").select("conv_id", *counts)
    many = heads.alias("h").join(hashed.alias("d"), F.col("h.conv_id").eqNullSafe(F.col("d.conv_id"))).select("h.conv_id", *counts, "d.audit", "d.repaired_sha256")
    return whole.unionByName(many)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and present of conversations with every fifth turn or so damaged in one of five ways, by its ids' crc32."""
    space = lambda c: F.coalesce(conversations[c].cast("string"), F.lit(" "))
    key = F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")
    rows = conversations.select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), (F.crc32(key) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.col("kind") != 0, F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("present"))
