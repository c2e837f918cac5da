"""Repair of the structure of conversations by Hirschberg's divide and conquer.

The rows of a conversation, in order of turn, are edited until their role initials read
``(s?(ua)+)?``: Keep costs 0, Rerole (to user or assistant) 1, Delete 2, Insert (an empty user or
assistant row) 5. A row's first fault counts: a blank one and one whose role and text were seen before
must be deleted, a truncated one costs 5 unless it is. Of the cheapest ways the one whose audit, the
initials of its edits, is the least in ASCII is taken.

The pattern has four states (nothing yet, after s, after u, after a), so a stretch of rows is
described by what it costs to get from one state to another. A way is found in linear space: the costs
forward from the beginning and backward from the end meet in the middle, the best state there is
chosen, and both halves are solved by themselves. Among states that cost the same the
one with the least audit so far is right: audits of equally many rows end with a row's own edit, so none
is the beginning of another, and their order decides. With the costs forward goes therefore only
the order of the four audits, not their texts.

Large conversations: rows are sorted by ranges, and a conversation that crosses ranges is solved
in three steps: each range sums up its rows as costs and order of audits between states; the
same divide and conquer over these sums, as many as there are ranges, gives the states at the
borders; then each range solves its own rows. Only the digest of the repaired text of one conversation
has to read it in order, row by row, in one task.

Results for odd input: a null conv_id is a conversation of its own; null roles and texts are one
space; null turns come first; rows of one turn are ordered by the md5 of role and text, and rows
that are equal in all are counted first, so they are one row with repetitions; an empty role has an empty
initial, which can't be kept; gaps that exceed 64 bits are null; an empty table gives an empty result;
further columns are ignored; texts may be of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from causeway.llm.common import Work

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
# Faults of a row.
NONE, BLANK, DUPLICATE, CUT_OFF = range(4)
# States: nothing yet, after s, after u, after a.
STATES = range(4)
# The state after an initial, by state; a missing one is not allowed.
_AFTER = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
# The role that a new or changed row gets in a state, and the state after it.
_NEXT = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
# What is left to pay at the end of a conversation: inserts until the pattern is whole.
_TAIL = (0, 2 * INSERT, INSERT, 0)
_TAIL_ROLES = ("", "UA", "A", "")
_SPACE = " \t\n\x0b\x0c\r"

# A way from one state to another: its cost and what orders it among the ways from the same state.
Step = tuple[dict[int, tuple], ...]
# Per state: the cost beyond that of the cheapest, and the place of its audit in the order of all four; None if out of reach.
Vector = tuple[tuple[int, int] | None, ...]


def row_step(initial: str, fault: int) -> tuple[dict[int, tuple[int, str, str]], ...]:
    """Per state before and after a row: (cost, audit, roles), the cheapest, then least audit.

    ``roles`` tells what is written: U and A for inserted rows, k for a kept one, u and a for a changed role, d for a deleted row.
    """
    made = []
    for start in STATES:
        best: dict[int, tuple[int, str, str]] = {}
        state, cost, audit, roles = start, 0, "", ""
        for _ in range(3):  # more than two inserts reach no further state
            ways = [(state, DELETE, "D", "d")]
            if fault in (NONE, CUT_OFF):
                more = TRUNCATED if fault == CUT_OFF else 0
                if state in _AFTER.get(initial, {}):
                    ways.append((_AFTER[initial][state], KEEP + more, "K", "k"))
                ways.append((_NEXT[state][1], REROLE + more, "R", _NEXT[state][0]))
            for after, extra, letter, role in ways:
                way = (cost + extra, audit + letter, roles + role)
                best[after] = min(best.get(after, way), way)
            role, state = _NEXT[state]
            cost, audit, roles = cost + INSERT, audit + "I", roles + role.upper()
        made.append(best)
    return tuple(made)


def _levelled(ways: dict[int, tuple]) -> Vector:
    """Per state (cost, order) to costs above the least and places in the order."""
    least = min(w[0] for w in ways.values())
    order = {w: i for i, w in enumerate(sorted(w[1] for w in ways.values()))}
    return tuple((ways[s][0] - least, order[ways[s][1]]) if s in ways else None for s in STATES)


def start_from(state: int) -> Vector:
    return tuple((0, 0) if s == state else None for s in STATES)


def forward(vector: Vector, step: Step) -> Vector:
    ways: dict[int, tuple] = {}
    for state, here in enumerate(vector):
        if here is not None:
            for after, way in step[state].items():
                found = here[0] + way[0], (here[1], way[1])
                ways[after] = min(ways.get(after, found), found)
    return _levelled(ways)


def backward(costs: tuple, step: Step) -> tuple:
    """Costs to the end from before the step, above the least; None where the end can't be reached."""
    found = [min((way[0] + costs[after] for after, way in step[s].items() if costs[after] is not None), default=None) for s in STATES]
    least = min(c for c in found if c is not None)
    return tuple(None if c is None else c - least for c in found)


def _crossing(ahead: Vector, behind: Sequence) -> int:
    ways = [(ahead[s][0] + behind[s], ahead[s][1], s) for s in STATES if ahead[s] is not None and behind[s] is not None]
    return min(ways)[2]


def states_along(n: int, step: Callable[[int], Step | tuple], start: int, end: Sequence,
                 go: Callable = forward, back: Callable = backward) -> list[int]:
    """The states before, between and after n steps on the best way from ``start``; ``end`` has what each last state costs."""
    vector = start_from(start)
    for i in range(n):
        vector = go(vector, step(i))
    states = [start] * n + [_crossing(vector, end)]
    open_ = [(0, n)]
    while open_:
        low, high = open_.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        ahead = start_from(states[low])
        for i in range(low, middle):
            ahead = go(ahead, step(i))
        behind = tuple(0 if s == states[high] else None for s in STATES)
        for i in range(high - 1, middle - 1, -1):
            behind = back(behind, step(i))
        states[middle] = _crossing(ahead, behind)
        open_ += [(low, middle), (middle, high)]
    return states


def _kinds(rows: list[dict]) -> list[tuple[str, int]]:
    return [(r["initial"] if r["initial"] in _AFTER else "", r["fault"]) for r in rows]


class Rows:
    """Steps over rows. The kinds of rows, and the vectors that occur, are few, so rows step from one to the next by looking it up."""

    def __init__(self):
        self.steps: dict[tuple[str, int], tuple] = {}
        self.onward: dict[tuple, Vector] = {}
        self.behind: dict[tuple, tuple] = {}

    def step(self, kind: tuple[str, int]) -> tuple:
        if kind not in self.steps:
            self.steps[kind] = row_step(*kind)
        return self.steps[kind]

    def forward(self, vector: Vector, kind: tuple[str, int]) -> Vector:
        found = self.onward.get((vector, kind))
        if found is None:
            found = self.onward[vector, kind] = forward(vector, self.step(kind))
        return found

    def backward(self, costs: tuple, kind: tuple[str, int]) -> tuple:
        found = self.behind.get((costs, kind))
        if found is None:
            found = self.behind[costs, kind] = backward(costs, self.step(kind))
        return found

    def states(self, kinds: list[tuple[str, int]], start: int, end: Sequence) -> list[int]:
        return states_along(len(kinds), kinds.__getitem__, start, end, self.forward, self.backward)

    def least_cost(self, kinds: list[tuple[str, int]], start: int) -> int:
        """The cost of the cheapest way, to whatever state; vectors hold only what is above it."""
        costs, total = {start: 0}, 0
        for kind in kinds:
            after: dict[int, int] = {}
            for s, cost in costs.items():
                for t, way in self.step(kind)[s].items():
                    after[t] = min(after.get(t, cost + way[0]), cost + way[0])
            least = min(after.values())
            costs, total = {t: c - least for t, c in after.items()}, total + least
        return total


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of the rows that are left, damaged by the checksum of conversation and turn."""
    place = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(place[0], F.lit(":"), place[1]).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).cast("bigint").alias("copies"))


def in_order(rows: DataFrame, work: Work) -> DataFrame:
    """Distinct rows with copies, ``at`` (their place in order), ``part`` (the range they lie in), ``key`` (of role and text) and ``fault``.

    The fault is without regard to duplicates. Ranges are cut by conversation, turn and key, so a large
    conversation, or turn, lies in as many ranges as it needs.
    """
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    end = F.rtrim("text", F.lit(_SPACE))
    fault = F.when(end == "", BLANK).when(F.right(end, F.lit(1)).isin(*".!?"), NONE).otherwise(CUT_OFF)
    rows = rows.select("*", F.md5(whole.cast("binary")).alias("key"), fault.alias("fault"))
    parts = int(work.spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "key"]
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The upper bits hold the range, the lower 33 the place in it.
    placed = work.cut(placed.withColumn("at", F.monotonically_increasing_id()))
    return placed.withColumn("part", F.shiftright("at", 33))


def _seen_before(rows: DataFrame) -> DataFrame:
    """(at) of the rows whose role and text occur earlier in their conversation."""
    slim = rows.select("conv_id", "key", "at")
    first = slim.groupBy("conv_id", "key").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select(F.col("conv_id").alias("c"), F.col("key").alias("k"), "first")
    return slim.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k"))).where("at > first").select("at")


def segments(rows: DataFrame, work: Work) -> DataFrame:
    """One row per conversation and range: its rows without texts, in order, and the number of rows with each fault."""
    later = _seen_before(rows).withColumn("later", F.lit(True))
    slim = rows.select("conv_id", "part", "at", F.substring("role", 1, 1).alias("initial"), "fault", "copies").join(later, "at", "left")
    fault = F.when(F.col("later") & (F.col("fault") != BLANK), DUPLICATE).otherwise(F.col("fault"))
    slim = slim.withColumn("fault", fault)
    one = F.lit(1).cast("bigint")
    return work.cut(slim.groupBy("conv_id", "part").agg(
        F.sort_array(F.collect_list(F.struct("at", "initial", "fault", "copies"))).alias("rows"),
        F.sum(F.when(F.col("fault") == BLANK, F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == BLANK, 0).when(F.col("fault") == DUPLICATE, F.col("copies")).otherwise(F.col("copies") - 1)).alias("duplicate"),
        F.sum(F.when(F.col("fault") == CUT_OFF, one).otherwise(0)).alias("truncated")))


def _summed(wide: DataFrame) -> DataFrame:
    """Of each segment the costs and the order of audits between all states, as 16 numbers each; -1 is out of reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Rows()
        for batch in batches:
            costs, places = [], []
            for rows in batch.column(2):
                kinds, cost, place = _kinds(rows.as_py()), [], []
                for start in STATES:
                    vector, total = start_from(start), known.least_cost(kinds, start)
                    for kind in kinds:
                        vector = known.forward(vector, kind)
                    cost += [-1 if v is None else v[0] + total for v in vector]
                    place += [-1 if v is None else v[1] for v in vector]
                costs.append(cost)
                places.append(place)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(costs, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))],
                                  names=["conv_id", "part", "costs", "places"])

    return wide.select("conv_id", "part", "rows").mapInArrow(run, "conv_id bigint, part bigint, costs array<bigint>, places array<int>")


def _borders(summed: DataFrame) -> DataFrame:
    """(conv_id, part, first, last) for conversations in several ranges: the states at the borders of their segments."""
    # One row per range, so the list is as long as there are ranges.
    lists = summed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "costs", "places"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, parts in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts = parts.as_py()
                steps = [tuple({t: (p["costs"][4 * s + t], p["places"][4 * s + t]) for t in STATES if p["costs"][4 * s + t] >= 0} for s in STATES)
                         for p in parts]
                states = states_along(len(steps), steps.__getitem__, 0, _TAIL)
                yield pa.record_batch([pa.array([conv] * len(parts), pa.int64()), pa.array([p["part"] for p in parts], pa.int64()),
                                       pa.array(states[:-1], pa.int32()), pa.array(states[1:], pa.int32()),
                                       pa.array([i + 1 == len(parts) for i in range(len(parts))])],
                                      names=["conv_id", "part", "first", "last", "ends"])

    return lists.mapInArrow(run, "conv_id bigint, part bigint, first int, last int, ends boolean")


_SOLVED = ("conv_id bigint, part bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, opening string, closing string, "
           "cost bigint, audit string, edits array<struct<at:bigint,kind:int,roles:string>>")


def _legal(pair: str) -> bool:
    return pair in ("su", "ua", "au")


def _solved(found: DataFrame) -> DataFrame:
    """Each segment's edits. ``first`` and ``last`` are its states at the borders, null for a whole conversation."""

    def solve(known: Rows, rows: list[dict], first: int | None, last: int | None, ends: bool | None) -> tuple[int, int, str, list[dict]]:
        whole = first is None
        kinds = _kinds(rows)
        states = known.states(kinds, 0 if whole else first, _TAIL if whole else [0 if s == last else None for s in STATES])
        cost, illegal, audit, edits = 0, 0, [], []
        for i, (row, kind) in enumerate(zip(rows, kinds)):
            paid, letters, roles = known.step(kind)[states[i]][states[i + 1]]
            more = row["copies"] - 1
            cost += paid + DELETE * more
            audit += (letters, "D" * more)
            edits.append({"at": row["at"], "kind": 0, "roles": roles})
            illegal += more + (i > 0 and not _legal(rows[i - 1]["initial"] + row["initial"]))
        if whole or ends:
            cost += _TAIL[states[-1]]
            audit.append("I" * len(_TAIL_ROLES[states[-1]]))
            if _TAIL_ROLES[states[-1]]:
                edits.append({"at": rows[-1]["at"], "kind": 2, "roles": _TAIL_ROLES[states[-1]]})
        return cost, illegal, "".join(audit), edits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Rows()
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024).to_pydict()
                made = [solve(known, *x) for x in zip(part["rows"], part["first"], part["last"], part["ends"])]
                out = {name: part[name] for name in ("conv_id", "part", "blank", "duplicate", "truncated")}
                out |= {"illegal": [m[1] for m in made], "opening": [r[0]["initial"] for r in part["rows"]],
                        "closing": [r[-1]["initial"] for r in part["rows"]], "cost": [m[0] for m in made],
                        "audit": [m[2] for m in made], "edits": [m[3] for m in made]}
                yield pa.RecordBatch.from_pydict(out, schema=_SOLVED_ARROW)

    return found.mapInArrow(run, _SOLVED)


_SOLVED_ARROW = pa.schema([
    *[(name, pa.int64()) for name in ("conv_id", "part", "blank", "duplicate", "truncated", "illegal")], ("opening", pa.string()),
    ("closing", pa.string()), ("cost", pa.int64()), ("audit", pa.string()),
    ("edits", pa.list_(pa.struct([("at", pa.int64()), ("kind", pa.int32()), ("roles", pa.string())])))])

_ROLES = {"U": "user", "A": "assistant", "u": "user", "a": "assistant"}


def _written(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """(conv_id, at, kind, role, text, roles) in order: each row preceded by its edit; the inserts at the end come last."""
    edits = solved.select("conv_id", F.explode("edits").alias("e")).select(
        "conv_id", "e.at", "e.kind", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "e.roles")
    texts = rows.select("conv_id", "at", F.lit(1).alias("kind"), "role", "text", F.lit(None).cast("string").alias("roles"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return edits.union(texts).repartition(parts, "conv_id").sortWithinPartitions("conv_id", "at", "kind")


def repaired_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str | None, str | None]]:
    """(conv_id, role, text) of the repaired rows; a conversation begins with a row without role."""
    conv: object = batches
    roles = ""
    for batch in batches:
        for here, kind, role, text, edit in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", "roles"))):
            if here != conv:
                conv = here
                yield conv, None, None
            if kind == 1:
                if roles[-1] != "d":
                    yield conv, role if roles[-1] == "k" else _ROLES[roles[-1]], text
            else:
                roles = edit
                for letter in roles if kind == 2 else roles[:-1]:
                    yield conv, _ROLES[letter], ""


def _digests(written: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256), read row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convs, made, digest, lines = [], [], None, 0

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(convs[:len(made)], pa.int64()), pa.array(made, pa.string())], names=["conv_id", "repaired_sha256"])

        for conv, role, text in repaired_rows(batches):
            if role is None:
                if digest is not None:
                    made.append(digest.hexdigest())
                if len(made) >= 4096:
                    yield batch()
                    convs, made = [], []
                convs.append(conv)
                digest, lines = hashlib.sha256(), 0
            else:
                digest.update(("\n" if lines else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                lines += 1
        if digest is not None:
            made.append(digest.hexdigest())
        yield batch()

    return written.mapInArrow(run, "conv_id bigint, repaired_sha256 string")


def _solve(rows: DataFrame, work: Work) -> tuple[DataFrame, DataFrame]:
    """The rows in order, and the solved segments."""
    placed = in_order(rows, work)
    parts = segments(placed, work)
    several = parts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("c"))
    # At most two conversations of a range go on beyond it, so these tables have two rows per range at most.
    wide = parts.join(several, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    borders = work.cut(_borders(_summed(wide))).select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "first", "last", "ends")
    found = parts.join(borders, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left").drop("c", "p")
    return placed, work.cut(_solved(found))


def repair(rows: DataFrame) -> DataFrame:
    """The repaired rows (conv_id, place, role, text) of conversations (conv_id, turn, role, text)."""
    work = Work(rows.sparkSession)
    space = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    placed, solved = _solve(rows.select("conv_id", "turn", *space, F.lit(1).cast("bigint").alias("copies")), work)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, made = 0, ([], [], [], [])
        for conv, role, text in repaired_rows(batches):
            place = 0 if role is None else place + 1
            if role is not None:
                for column, value in zip(made, (conv, place - 1, role, text)):
                    column.append(value)
            if len(made[0]) >= 4096:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(made, types)], names=["conv_id", "place", "role", "text"])
                made = ([], [], [], [])
        yield pa.record_batch([pa.array(c, t) for c, t in zip(made, types)], names=["conv_id", "place", "role", "text"])

    types = (pa.int64(), pa.int64(), pa.string(), pa.string())
    return _written(placed, solved).mapInArrow(run, "conv_id bigint, place bigint, role string, text string")


def _difference(high: Column, low: Column, distinct: Column) -> Column:
    wide = [c.cast("decimal(20,0)") for c in (high, low, distinct)]
    return (wide[0] - wide[1] + 1 - wide[2]).try_cast("bigint")


def audit(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """Per conversation of ``conversations`` (conv_id) the faults, cheapest audit and digest of its ``rows`` (with copies)."""
    work = Work(rows.sparkSession)
    placed, solved = _solve(rows, work)
    digests = _digests(_written(placed, solved))
    turns = placed.groupBy("conv_id").agg(F.max("turn").alias("high"), F.min("turn").alias("low"), F.count_distinct("turn").alias("n"))
    gaps = F.coalesce(_difference(F.col("high"), F.col("low"), F.col("n")), F.when(F.col("high").isNull(), 0))
    turns = turns.select("conv_id", gaps.cast("bigint").alias("gaps"))
    # One row per range.
    pieces = F.sort_array(F.collect_list(F.struct("part", "opening", "closing", "audit")))
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    whole = solved.groupBy("conv_id").agg(*sums, pieces.alias("pieces"))
    pairs = F.zip_with(F.slice("pieces", F.lit(1), F.size("pieces") - 1), F.slice("pieces", F.lit(2), F.size("pieces") - 1),
                       lambda a, b: F.concat(a["closing"], b["opening"]))
    between = F.size(F.filter(pairs, lambda pair: ~pair.isin("su", "ua", "au")))
    whole = whole.select("conv_id", "blank", "duplicate", "truncated", (F.col("illegal") + between).alias("illegal"), "cost",
                         F.array_join(F.transform("pieces", lambda p: p["audit"]), "").alias("audit"))
    result = conversations.select(F.col("conv_id").alias("c")).distinct()
    for other in (turns, whole, digests):
        result = result.join(other, F.col("c").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    zero = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.col("audit").isNull()
    return result.select(F.col("c").alias("conv_id"), F.when(nothing, F.lit(0).cast("bigint")).otherwise(F.col("gaps")).alias("gaps"), *zero,
                         F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
