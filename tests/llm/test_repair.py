import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from causeway.llm import conversation_repair as cr
from causeway.llm.queries import op13_conversation_repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, copies string, at string, fault string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        out.append(cr.BLANK if not last else cr.DUPLICATE if (role, text) in seen else cr.CUT_OFF if last[0] not in ".!?" else cr.NONE)
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, lines), tried from the last row on, state by state."""
    def after(state, initial):
        return {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(initial, {}).get(state)

    def inserted(state):
        lines = []
        yield state, 0, "", []
        for n in (1, 2):
            lines = [*lines, "assistant:" if state == 2 else "user:"]
            state = after(state, lines[-1][0])
            yield state, 5 * n, "I" * n, lines

    best = {s: min((c, a, x) for t, c, a, x in inserted(s) if t in (0, 3)) for s in range(4)}
    for (_, _, role, text), fault in reversed(list(zip(rows, found))):
        new = {}
        for s in range(4):
            ways = []
            for t, cost, audit, lines in inserted(s):
                own = [(t, 2, "D", [])]
                if fault in (cr.NONE, cr.CUT_OFF):
                    more = 5 if fault == cr.CUT_OFF else 0
                    if after(t, role[:1]) is not None:
                        own.append((after(t, role[:1]), more, "K", [f"{role}:{text}"]))
                    changed = "assistant" if t == 2 else "user"
                    own.append((after(t, changed[0]), 1 + more, "R", [f"{changed}:{text}"]))
                for u, paid, letter, line in own:
                    rest = best[u]
                    ways.append((cost + paid + rest[0], audit + letter + rest[1], lines + line + rest[2]))
            new[s] = min(ways)
        best = new
    return best[0]


def plain(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (
            r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))
        found = faults(mine)
        cost, audit, lines = cheapest(mine, found)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out[conv] = (gaps, found.count(cr.BLANK), found.count(cr.DUPLICATE), found.count(cr.CUT_OFF), illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations():
    rng = random.Random(13)
    rows = []
    for conv in [*range(150), None]:
        n = rng.choice([1, 2, 4, 7, 12, 40])
        for turn in range(n):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]) if rng.random() < 0.4 else (
                "user" if turn % 2 == 0 else "assistant")
            text = rng.choice(["Yes.", "a b", " ", "", None, "Why?\n", "end. ", f"own {conv} {turn}!", f"own {conv} {turn}.", "\x0b"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, turn * 2, None]), role, text))
    return rows + rows[:40] + [(900, 0, "user", "Long? " * 30000), (900, 1, "assistant", "Long. " * 30000), (901, 5, "user", None), (902, None, "a", "b.")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


@pytest.mark.parametrize("parts", ["4", "23"])
def test_equals_plain_version(spark, tmp_path, parts):
    rows = conversations()
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = op13_conversation_repair(spark, str(tmp_path))
        assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_hot_conversation_over_many_ranges(spark):
    """One conversation of nearly all rows, without ties of turns, is solved in pieces that meet."""
    rng = random.Random(31)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]) if rng.random() < 0.5 else ("user" if t % 2 else "assistant"),
             rng.choice([f"text {t}.", f"text {t}", f"again {t % 9}!"])) for t in range(3000)] + [(2, 0, "user", "Yes.")] + [(3, 5, "s", "x.")] * 700
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        given_ = frame(spark, rows)
        made = cr.audit(cr.damage(given_), given_)
        assert {r.conv_id: tuple(r)[1:] for r in made.collect()} == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


STEPS = st.lists(st.tuples(st.sampled_from(["s", "u", "a", ""]), st.sampled_from([cr.NONE, cr.NONE, cr.BLANK, cr.CUT_OFF])), max_size=14)


def _written(kinds, states):
    ways = [cr.row_step(*k)[a][b] for k, a, b in zip(kinds, states, states[1:])]
    tail = cr._TAIL_ROLES[states[-1]]
    return sum(w[0] for w in ways) + 5 * len(tail), "".join(w[1] for w in ways) + "I" * len(tail)


@settings(max_examples=400, deadline=None)
@given(STEPS, st.integers(0, 14))
def test_halves_meet_in_the_least_audit(kinds, cut):
    rows = [(1, i, k[0], f"{i}") for i, k in enumerate(kinds)]
    want = cheapest(rows, [k[1] for k in kinds])
    known = cr.Rows()
    assert _written(kinds, known.states(kinds, 0, cr._TAIL)) == want[:2]
    # Cut into two segments, of which the sums alone give the border.
    pieces, steps = [p for p in (kinds[:cut], kinds[cut:]) if p], []
    for piece in pieces:
        step = []
        for start in cr.STATES:
            vector, least = cr.start_from(start), known.least_cost(piece, start)
            for kind in piece:
                vector = known.forward(vector, kind)
            step.append({t: (v[0] + least, v[1]) for t, v in enumerate(vector) if v is not None})
        steps.append(tuple(step))
    if pieces:
        border = cr.states_along(len(steps), steps.__getitem__, 0, cr._TAIL)
        states = [0]
        for i, piece in enumerate(pieces):
            states += known.states(piece, border[i], [0 if s == border[i + 1] else None for s in cr.STATES])[1:]
        assert _written(kinds, states) == want[:2]


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "user", "Hello."), (1, 3, "user", " "), (2, 0, "assistant", "No end"),
            (None, None, None, "x."), (None, None, None, "y.")]
    first, second = sorted(("x.", "y."), key=lambda t: hashlib.md5(f"1: {t}".encode()).hexdigest())
    got = {tuple(r) for r in cr.repair(frame(spark, rows)).collect()}
    assert got == {(1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello."),
                   (None, 0, "user", first), (None, 1, "assistant", second)}


def test_empty_tables(spark):
    none = frame(spark, conversations()).limit(0)
    assert cr.repair(none).count() == 0 and cr.audit(cr.damage(none), none).count() == 0
    # All of a conversation's rows are dropped.
    gone = next((c, t) for c in range(100) for t in range(5) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    one = frame(spark, [(*gone, "user", "x")])
    assert [tuple(r) for r in cr.audit(cr.damage(one), one).collect()] == [(gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    far = frame(spark, [(1, -2**63, "user", "a."), (1, 2**63 - 1, "user", "b.")])
    rows = far.select("conv_id", "turn", "role", "text").selectExpr("*", "1L AS copies")
    assert [r.gaps for r in cr.audit(rows, far).collect()] == [None]
