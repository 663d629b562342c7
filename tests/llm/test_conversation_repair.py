import hashlib
import itertools
import random
import re
import zlib

import pytest

from sievekit.llm import conversation_repair as cr
from sievekit.llm.queries import op11_conversation_repair

SF = "/root/testdata/sf0.001"
WS = "\x20\x09\x0a\x0b\x0c\x0d"


def row_faults(rows):
    """blank, duplicate, truncated or '' of each (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(WS)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else
                   "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def dp(rows):
    """(cost, audit, repaired): one table of whole edit strings by state, no tree."""
    steps = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    turn = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    def insert(best):
        for _ in range(3):
            for state, (cost, audit, out) in list(best.items()):
                way = (cost + 3, audit + "I", out + [(full[turn[state]], "")])
                if turn[state] not in best or way < best[turn[state]]:
                    best[turn[state]] = way
        return best

    best = insert({"": (0, "", [])})
    for (role, text), fault in zip(rows, row_faults(rows)):
        after = {}
        for state, (cost, audit, out) in best.items():
            ways = [(state, cost + 4, "D", out)]
            if fault in ("", "truncated"):
                more = 3 if fault else 0
                if (state, role[:1]) in steps:
                    ways.append((steps[state, role[:1]], cost + more, "K", out + [(role, text)]))
                ways.append((turn[state], cost + 3 + more, "R", out + [(full[turn[state]], text)]))
            for to, total, edit, held in ways:
                if to not in after or (total, audit + edit) < after[to][:2]:
                    after[to] = (total, audit + edit, held)
        best = insert(after)
    return min(best[s] for s in ("", "a") if s in best)


def every_way(rows):
    """(cost, audit) over all edit strings with up to two insertions at a place."""
    fault = row_faults(rows)
    best = None
    for edits in itertools.product("KRD", repeat=len(rows)):
        if any(f in ("blank", "duplicate") and e != "D" for f, e in zip(fault, edits)):
            continue
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "I" * gaps[0] + "".join(e + "I" * g for e, g in zip(edits, gaps[1:]))
            kept = iter(zip(rows, edits))
            roles = ""
            for e in audit:
                if e == "I":
                    roles += "?"
                else:
                    (role, _), _ = next(kept)
                    roles += {"K": role[:1] or "-", "R": "?", "D": ""}[e]
            want = ("s" if roles[:1] == "s" else "") + "ua" * len(roles)
            if roles == "s" or len(roles) % 2 != (roles[:1] == "s") or any(r not in ("?", w) for r, w in zip(roles, want)):
                continue
            cost = sum({"K": 0, "R": 3, "D": 4, "I": 3}[e] for e in audit)
            cost += sum(3 for f, e in zip(fault, edits) if f == "truncated" and e != "D")
            best = min(best or (cost, audit), (cost, audit))
    return best


def draw_rows(draw, n):
    texts = ["Done.", "Why?", "no end", "", " \t", "Yes! ", "x.", "y", "z.", "v?", "w!"]
    return [(draw.choice(["user", "assistant", "system", "tool", "u2", " "]), draw.choice(texts)) for _ in range(n)]


def pushed(rows):
    seen, out = set(), []
    for r in rows:
        out.append((*r, 1, r in seen))
        seen.add(r)
    return out


def test_table_equals_every_way():
    draw = random.Random(1)
    for n in (0, 1, 2, 3, 3, 3, 4):
        for _ in range(6):
            rows = draw_rows(draw, n)
            assert dp(rows)[:2] == every_way(rows), rows


def test_survivors_equal_the_table():
    draw = random.Random(2)
    for _ in range(400):
        rows = draw_rows(draw, draw.choice([0, 1, 2, 5, 9, 30]))
        cost, audit, repaired = cr.repair_rows(pushed(rows))
        assert (cost, audit, repaired) == dp(rows), rows


def test_edits_leave_the_tree_early():
    """An ordinary conversation, however long, holds a few unresolved edits."""
    rows = [(("user", "assistant")[i % 2], f"text {i}.", 1, False) for i in range(5000)]
    r, done = cr.Repairer(), 0
    for edits in cr.push_rows(r, rows):
        done += len(edits)
        assert max(len(r._path(t)) for t in r.tip if t) <= 12
    assert done >= 4985


def test_ties_stay_whole():
    """A tie that lasts for many rows is decided by its first difference."""
    rows = [("user", "a."), *[("user", f"{i}.") for i in range(300)]]
    assert cr.repair_rows(pushed(rows)) == dp(rows)


def test_blocks_equal_the_whole():
    """Costs through blocks, folded from the end, give the same edits."""
    draw = random.Random(3)
    for _ in range(300):
        rows = pushed(draw_rows(draw, draw.choice([3, 8, 20])))
        cuts = sorted(draw.sample(range(len(rows) + 1), 2))
        blocks = [rows[:cuts[0]], rows[cuts[0]:cuts[1]], rows[cuts[1]:]]
        rest, ahead, best = [0 if s in cr.ENDS else None for s in range(4)], [""] * 4, []
        for i, b in reversed(list(enumerate(blocks))):
            rest, ahead, to = cr.rest_of(*cr.ways_through(b, i == 0), rest, ahead)
            best.insert(0, to)
        state, cost, audit, repaired = cr.START, 0, "", []
        for i, (b, to) in enumerate(zip(blocks, best)):
            one = cr.repair_rows(b, state, i == 0, to[state])
            cost, audit, repaired, state = cost + one[0], audit + one[1], repaired + one[2], to[state]
        assert (cost, audit, repaired) == cr.repair_rows(rows), rows


def brute(rows):
    """The whole report of (conv_id, turn, role, text) rows."""
    convs = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        held = convs.setdefault(conv, [])
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        role = "user" if draw == 4 else role
        held += [(turn, role, text)] * {0: 0, 3: 2}.get(draw, 1)
    out = []
    for conv, held in convs.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        pairs = [r[1:] for r in held]
        fault = row_faults(pairs)
        turns = [t for t, *_ in held if t is not None]
        cost, audit, repaired = dp(pairs)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, fault.count("blank"),
                    fault.count("duplicate"), fault.count("truncated"), illegal, cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()))
    return sorted(map(str, out))


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.collect())


def given():
    draw = random.Random(5)
    rows = [(c, t, *draw_rows(draw, 1)[0]) for c in range(60) for t in range(draw.choice([1, 4, 9]))]
    rows += [(c, draw.choice([None, 0, 1, 2, 2**40]), draw.choice([None, "user", "assistant"]),
              draw.choice([None, "", "Same.", "é" * 5 + "!", "x" * 200_000 + "."])) for c in range(60, 80) for _ in range(6)]
    rows += [(None, t, "user", "Null.") for t in range(4)] + [(99, 7, "user", "Copy.")] * 500
    return rows + [(100, t, ("user", "assistant")[t % 2], f"{t % 900}.") for t in range(3000)]


def frame(spark, rows):
    return (spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
            .selectExpr("*", "'own' block", "1 digest", "2 alone", "'x' cost").repartition(5))


@pytest.mark.parametrize("block_rows", [1024, 7])
def test_report(spark, monkeypatch, block_rows):
    monkeypatch.setattr(cr, "BLOCK_ROWS", block_rows)
    rows = given()
    assert rows_of(cr.report(cr.damage(frame(spark, rows)), "copies")) == brute(rows)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(op11_conversation_repair(spark, SF)) == brute(rows)


def test_repaired_turns(spark):
    """Undamaged rows, as a user of the operator gives them."""
    got = cr.repaired_turns(frame(spark, [(1, 0, "system", "S."), (1, 1, "user", "Q?"), (1, 2, "user", "More?"),
                                          (1, 3, "assistant", "A."), (2, 0, "assistant", "")]))
    assert [tuple(r)[2:] for r in got.orderBy("conv_id", "block", "at").collect()] == [
        (0, "system", "S."), (1, "user", "Q?"), (2, "assistant", ""), (3, "user", "More?"), (4, "assistant", "A.")]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.report(cr.damage(empty), "copies").collect() == []
    assert cr.repaired_turns(empty).collect() == []
