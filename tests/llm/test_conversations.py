import hashlib
import random
import re

import pytest

from lumenfield.llm import conversations as cv
from lumenfield.llm.queries import damaged_turns

SCHEMA = "conv_id long, turn long, role string, text string"


def order(rows):
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def brute(rows):
    """One conversation, all audits: strings are kept whole for each state."""
    rows = order(rows)
    seen, faults = set(), []
    for _, _, role, text in rows:
        end = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    give = {"": "u", "s": "u", "u": "a", "a": "u"}
    live = {"": (0, "", ())}
    for (_, _, role, text), fault in zip(rows, faults):
        after = {}

        def offer(state, way, after=after):
            if state not in after or way < after[state]:
                after[state] = way

        for state, (cost, audit, lines) in live.items():
            for run in range(4):
                offer(state, (cost + 4, audit + "D", lines))
                if fault in ("", "t"):
                    more = 3 if fault else 0
                    to = give[state]
                    offer(to, (cost + 3 + more, audit + "R", (*lines, f"{'user' if to == 'u' else 'assistant'}:{text}")))
                    if role[:1] == give[state] or (role[:1] == "s" and state == ""):
                        offer(role[:1], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
                state = give[state]
                cost, audit, lines = cost + 3, audit + "I", (*lines, "user:" if state == "u" else "assistant:")
        live = after
    ends = []
    for state, (cost, audit, lines) in live.items():
        while state not in ("", "a"):
            state = give[state]
            cost, audit, lines = cost + 3, audit + "I", (*lines, "user:" if state == "u" else "assistant:")
        ends.append((cost, audit, lines))
    cost, audit, lines = min(ends)
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def some(seed, convs, longest=12):
    rng = random.Random(seed)
    out = []
    for c in range(convs):
        for t in range(rng.randint(0, longest)):
            turn = rng.choice([t, t, t, t * 2, None, 3])
            out.append((c, turn, rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice(["Yes.", "No!", "cut off", "", " \t", None, f"Say {t}.", f"Half {t}", "Yes."])))
    return out


def reported(spark, rows, convs=None, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.selectExpr("*", "'x' as kinds", "1 as first", "2 as audit")
    c = df if convs is None else spark.createDataFrame([(i, None, None, None) for i in convs], SCHEMA)
    return {r.conv_id: tuple(r)[1:] for r in cv.repair_report(c, df).collect()}


NOTHING = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_equal_to_brute_force(spark):
    rows = some(1, 150) + [(None, 1, "user", "Null."), (None, 2, "user", "Null again.")]
    got = reported(spark, rows, [*range(150), None, 999], extra=True)
    assert set(got) == {*range(150), None, 999} and got[999] == NOTHING
    for c in got:
        mine = [r for r in rows if r[0] == c]
        assert got[c] == (brute(mine) if mine else NOTHING), c


@pytest.mark.parametrize("shift", [0, 2])
def test_segments_change_nothing(spark, monkeypatch, shift):
    """One conversation over many segments and range partitions, and identical rows over their borders."""
    monkeypatch.setattr(cv, "SHIFT", shift)
    monkeypatch.setattr(cv, "SORT_BYTES", 1)
    rows = some(2, 12) + [(77, *r[1:]) for r in some(3, 1, 60) + some(4, 1, 60) + some(5, 1, 60)] + [(77, 5, "user", "Same.")] * 40
    got = reported(spark, rows)
    for c in {r[0] for r in rows}:
        assert got[c] == brute([r for r in rows if r[0] == c]), c


def test_audits_are_of_the_wanted_form(spark):
    rows = some(6, 60)
    turns = {}
    for r in cv.repaired_turns(spark.createDataFrame(rows, SCHEMA)).collect():
        turns.setdefault(r.conv_id, []).append((r.position, r.role, r.text, r.edit))
    got = reported(spark, rows)
    for c, (*_, audit, sha) in got.items():
        mine = sorted(turns.get(c, []))
        assert [p for p, *_ in mine] == list(range(len(mine)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for _, r, _, _ in mine))
        assert "".join(e for *_, e in mine) == audit.replace("D", "")
        assert hashlib.sha256("\n".join(f"{r}:{x}" for _, r, x, _ in mine).encode()).hexdigest() == sha


def test_very_long_text_and_no_rows(spark):
    long = "word " * 200_000 + "end."
    got = reported(spark, [(1, 0, "user", long), (1, 1, "assistant", long), (1, 2, "user", long)])
    assert got[1] == brute([(1, 0, "user", long), (1, 1, "assistant", long), (1, 2, "user", long)])
    assert reported(spark, []) == {}
    assert cv.repaired_turns(spark.createDataFrame([], SCHEMA)).count() == 0


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant" if c % 3 else None, "Why? So! Yes." if t % 4 else None) for c in range(40) for t in range(6)] + [(None, 1, "user", "a."), (1, None, "user", "b.")]
    want = []
    for c, t, r, x in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if h:
            row = (c, t, "user" if h == 4 else r, "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x)
            want += [row] * (2 if h == 3 else 1)
    got = [tuple(r) for r in damaged_turns(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
