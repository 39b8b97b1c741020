"""Conversation repair against a table of states row by row, and cases that are easy to get wrong."""

import hashlib
import random
from zlib import crc32

import pytest

from fotoloom.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows, start=0, goals=(0, 3), tail=True):
    """(cost, letters) by keeping, row by row, the best letters to each state."""

    def inserted(now):
        out = dict(now)
        for _ in range(3):
            for q, (c, a) in list(out.items()):
                to = cr.NEXT[q][1]
                out[to] = min(out.get(to, (1 << 60, "")), (c + 3, a + "I"))
        return out

    now = {start: (0, "")}
    for initial, fault in rows:
        after = {}
        for q, (c, a) in inserted(now).items():
            options = [(q, c + 4, a + "D")]
            if fault not in (cr.BLANK, cr.DUPLICATE):
                more = 3 if fault == cr.CUT_SHORT else 0
                options += [(cr.NEXT[q][1], c + 3 + more, a + "R")] + ([(cr.AFTER[q, initial], c + more, a + "K")] if (q, initial) in cr.AFTER else [])
            for to, *option in options:
                after[to] = min(after.get(to, (1 << 60, "")), tuple(option))
        now = after
    now = inserted(now) if tail else now
    return min((now[q] for q in goals if q in now), default=None)


def brute(conversations, rows):
    """The registered query's rows from plain Python lists."""
    out = []
    for conv in dict.fromkeys(r[0] for r in conversations):
        own = sorted(((t is not None, t or 0, role if role is not None else " ", text if text is not None else " ") for c, t, role, text in rows if c == conv))
        seen, coded = set(), []
        for _, _, role, text in own:
            body = text.strip(" \t\n\v\f\r")
            fault = cr.BLANK if not body else cr.DUPLICATE if (role, text) in seen else cr.CUT_SHORT if body[-1] not in ".!?" else cr.FINE
            seen.add((role, text))
            coded.append((role[:1] if role[:1] in ("s", "u", "a") else "?", fault))
        cost, audit = cheapest(coded)
        state, lines, left = 0, [], list(zip(own, coded, strict=True))
        for letter in audit:
            if letter == "I":
                role, state = cr.NEXT[state]
                lines.append(f"{role}:")
                continue
            (_, _, role, text), (initial, _) = left.pop(0)
            if letter == "R":
                role, state = cr.NEXT[state]
            elif letter == "K":
                state = cr.AFTER[state, initial]
            if letter != "D":
                lines.append(f"{role}:{text}")
        turns = [t for has, t, *_ in own if has]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults = [f for _, f in coded]
        illegal = sum(a[2][:1] + b[2][:1] not in cr.LEGAL for a, b in zip(own, own[1:], strict=False))
        out.append((conv, gaps, *(faults.count(k) for k in (cr.BLANK, cr.DUPLICATE, cr.CUT_SHORT)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(map(repr, out))


def coded_rows(r, n):
    return [(r.choice("suuaaa?"), r.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(n)]


def test_search_is_the_table_of_states_for_all_ends():
    r = random.Random(5)
    for _ in range(600):
        rows = coded_rows(r, r.randint(1, 11))
        assert cr.Search(rows, {0, 3}, True).best(0) == cheapest(rows)
        for goal in range(4):
            assert cr.Search(rows, {goal}, False).best(s := r.randrange(4)) == cheapest(rows, s, (goal,), False)
    assert cr.Search([], {0, 3}, True).best(0) == (0, "")


def test_segments_chain_to_the_whole():
    r = random.Random(6)
    for _ in range(400):
        rows = coded_rows(r, r.randint(1, 14))
        size = r.randint(1, 4)
        parts = [rows[k : k + size] for k in range(0, len(rows), size)]
        pieces = []
        for k, part in enumerate(parts):
            last = k == len(parts) - 1
            found = [(s, min(goals), cr.Search(part, goals, last).best(s)) for goals in ([{0, 3}] if last else [{0}, {1}, {2}, {3}]) for s in (range(4) if k else [0])]
            pieces.append([(s, g, *f) for s, g, f in found if f])
        assert cr.chained(pieces) == cheapest(rows)


def table():
    r = random.Random(7)
    text = lambda: " ".join(r.choice(["yes", "no", "été", "x"]) for _ in range(r.randint(1, 3))) + r.choice([".", ".", "!", "?", "", ". \n", " \t"])
    rows = [(c, t, r.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), text()) for c in range(40) for t in range(r.randint(1, 9))]
    rows += [(100, t, ["user", "assistant"][t % 2], f"{t}.") for t in range(8)] + [(100, 3, "assistant", "3."), (100, 3, "assistant", "3a.")]
    rows += [(101, None, None, None), (101, 2, None, "a."), (101, None, "user", "b."), (102, None, "user", "c?"), (103, 5, "system", "only.")]
    rows += [(None, 0, "user", "d."), (None, 1, "assistant", "e"), (None, None, "system", "f."), (104, 0, "user", " "), (105, 0, "user", "long " * 60_000 + "."), (105, 1, "assistant", "g.")]
    r.shuffle(rows)
    return rows


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        hit = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if hit == 1 else "".join(c for c in text if c not in ".!?") if hit == 2 else text
        out += [(conv, turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


@pytest.mark.parametrize("segment", [128, 2])
def test_same_as_the_table_of_states(spark, monkeypatch, segment):
    monkeypatch.setattr(cr, "SEGMENT", segment)
    rows = table()
    df = spark.createDataFrame([(*r, "more", 1) for r in rows], SCHEMA + ", key string, i int").repartition(5)
    assert sorted(repr(tuple(x)) for x in cr.audited(df).collect()) == brute(rows, rows)


def test_damaged_rows_and_conversations_without_any(spark):
    rows = table() + [(c, 0, "user", "gone.") for c in range(200, 260)]
    hurt = damage(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(repr(tuple(x)) for x in cr.damaged(df).collect()) == sorted(map(repr, hurt))
    got = cr.audited(df, cr.damaged(df)).collect()
    want = brute(rows, hurt)
    assert sorted(repr(tuple(x)) for x in got) == want
    assert any(r["audit"] == "" and r["repaired_sha256"] == hashlib.sha256().hexdigest() and not r["cost"] for r in got)


def test_repaired_rows_read_as_turns(spark):
    rows = table()
    out = {}
    for r in cr.repaired(spark.createDataFrame(rows, SCHEMA)).collect():
        out.setdefault(r["conv_id"], []).append((r["pos"], r["role"], r["text"]))
    audits = {r["conv_id"]: r for r in cr.audited(spark.createDataFrame(rows, SCHEMA)).collect()}
    for conv, found in out.items():
        found.sort()
        roles = [x[1][:1] for x in found]
        assert [x[0] for x in found] == list(range(len(found)))
        assert roles[roles[:1] == ["s"] :] == ["u", "a"] * ((len(roles) - (roles[:1] == ["s"])) // 2)
        assert hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in found).encode()).hexdigest() == audits[conv]["repaired_sha256"]


def test_one_conversation_has_most_rows(spark):
    r = random.Random(8)
    rows = [(1, t, "user" if (t % 2) ^ (r.random() < 0.05) else "assistant", f"{t}" + r.choice([".", ".", ".", ""])) for t in range(700)] + [(2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    assert sorted(repr(tuple(x)) for x in cr.audited(spark.createDataFrame(rows, SCHEMA)).collect()) == brute(rows, rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cr.audited(empty).count() == 0 and cr.repaired(empty).count() == 0 and cr.damaged(empty).count() == 0
