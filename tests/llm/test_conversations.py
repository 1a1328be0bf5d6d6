import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from larder.llm import conversations
from larder.llm.conversations import Costs

SCHEMA = "conv_id long, turn long, role string, text string, at int, letters string, kind int"
NAMES = ("user", "assistant")


def order(role, text):
    def spelled(v):
        return f"{len(v.encode())}:{v}"
    return lambda conv: hashlib.sha256((("-:" if conv is None else spelled(str(conv))) + spelled(role) + spelled(text)).encode()).digest()


def damage(rows):
    """conv_id to its rows (turn, role, text) after damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kept = out.setdefault(conv, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, kept in out.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, order(r[1], r[2])(conv)))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else
                   "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def legal(initials):
    return re.fullmatch(r"(s?(ua)+)?", initials) is not None


def cheapest(rows, found, costs):
    """Every state of a table of whole strings: cost, audit, roles and texts by initials so far."""
    states = {"": (0, "", [])}

    def tail(initials):
        # What matters of the initials so far.
        return initials[-1:] if initials else ""

    def offer(to, key, value):
        if key not in to or value[:2] < to[key][:2]:
            to[key] = value

    def insert(table):
        for _ in range(3):
            for key, (c, a, kept) in list(table.items()):
                nxt = "a" if key == "u" else "u"
                offer(table, nxt, (c + costs.insert, a + "I", kept + [(NAMES[nxt == "a"], "")]))

    for (_, role, text), fault in zip(rows, found):
        insert(states)
        new = {}
        for key, (c, a, kept) in states.items():
            offer(new, key, (c + costs.delete, a + "D", kept))
            if fault in ("blank", "duplicate"):
                continue
            extra = costs.truncated * (fault == "truncated")
            if (key, role[:1]) in (("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")):
                offer(new, role[:1], (c + extra, a + "K", kept + [(role, text)]))
            nxt = "a" if key == "u" else "u"
            offer(new, nxt, (c + extra + costs.rerole, a + "R", kept + [(NAMES[nxt == "a"], text)]))
        states = new
    insert(states)
    best = min((states[k] for k in ("", "a") if k in states), key=lambda v: v[:2])
    return best


def every_edit(rows, found, costs, most=2):
    """The same by listing all edit sequences, for a few rows."""
    best = None
    gaps = [g for n in range(most + 1) for g in itertools.product(range(len(rows) + 1), repeat=n) if list(g) == sorted(g)]
    for edits in itertools.product("DKua", repeat=len(rows)):
        if any(e != "D" and f in ("blank", "duplicate") for e, f in zip(edits, found)):
            continue
        for g in gaps:
            for roles in itertools.product("ua", repeat=len(g)):
                cost, audit, initials = 0, "", ""
                for i in range(len(rows) + 1):
                    for at, role in zip(g, roles):
                        if at == i:
                            cost, audit, initials = cost + costs.insert, audit + "I", initials + role
                    if i < len(rows):
                        e = edits[i]
                        cost += {"D": costs.delete, "K": 0}.get(e, costs.rerole) + costs.truncated * (e != "D" and found[i] == "truncated")
                        audit += e if e in "DK" else "R"
                        initials += "" if e == "D" else (rows[i][1][:1] or "?") if e == "K" else e
                if legal(initials) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def brute(rows, costs=Costs(), damaged=True):
    out = {}
    for conv, kept in damage(rows).items():
        found = faults(kept)
        cost, audit, left = cheapest(kept, found, costs)
        turns = [t for t, _, _ in kept if t is not None]
        initials = [r[:1] for _, r, _ in kept]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, found.count("blank"), found.count("duplicate"),
            found.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest())
    return out


TEXTS = ["Yes.", "No!", "Why?", "cut off", "  ", "", None, "ü.", "done. \n", "Yes.", "long " * 30 + "."]
ROLES = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "s"]


def conversation(rng, conv, n):
    return [(conv, rng.choice([i, i, i, i + 3, None]), rng.choice(ROLES), rng.choice(TEXTS)) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("costs", [Costs(), Costs(3, 2, 1, 0), Costs(1, 1, 1, 1), Costs(2, 4, 1, 1)])
def test_audits_equal_all_edit_sequences(costs):
    rng = random.Random(5)
    for _ in range(25):
        rows = [(0, rng.choice(ROLES) or "", "Yes.") for _ in range(rng.randrange(5))]
        found = [rng.choice(["", "", "truncated", "blank"]) for _ in rows]
        want = cheapest(rows, found, costs)[:2]
        assert want == every_edit(rows, found, costs, 3 if len(rows) < 4 else 2)
        coded = [({"s": 1, "u": 2, "a": 3}.get(r[:1], 0), ["", "blank", "truncated", "duplicate"].index(f)) for (_, r, _), f in zip(rows, found)]
        assert conversations.audit(coded, costs) == want


@pytest.mark.parametrize("block", [conversations.BLOCK, 1, 7])
@pytest.mark.parametrize("costs", [Costs(), Costs(1, 1, 1, 1)])
def test_matches_brute_force(spark, block, costs):
    rng = random.Random(block)
    rows = [r for c in range(120) for r in conversation(rng, c, rng.randrange(1, 9))]
    rows += conversation(rng, None, 12) + conversation(rng, 1000, 400) + rows[:5]
    got = conversations.audited(conversations.damaged(table(spark, rows)), costs, block).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == brute(rows, costs) and len(got) == 122


def test_pieces_of_a_split_conversation(spark, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE", 40)
    monkeypatch.setattr(conversations, "ship_package", lambda spark: None)
    rng = random.Random(1)
    rows = conversation(rng, 5, 90) + conversation(rng, 6, 3)
    got = conversations.audited(conversations.damaged(table(spark, rows)), block=11).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == brute(rows)


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Yes?"), (1, 2, "assistant", "No."), (1, 2, "assistant", "No."), (2, 0, "tool", "x"), (3, 0, "user", "A.")]
    got = conversations.repaired(table(spark, rows), Costs(insert=1)).orderBy("conv_id", "place", "nth").collect()
    assert [(r["conv_id"], r["role"], r["text"], r["edit"]) for r in got] == [
        (1, "user", "Hi.", "K"), (1, "assistant", "", "I"), (1, "user", "Yes?", "K"), (1, "assistant", "No.", "K"),
        (3, "user", "A.", "K"), (3, "assistant", "", "I")]


def test_one_conversation_holds_all_rows(spark):
    """A hot conversation is cut, and what is composed is a row per block."""
    rng = random.Random(2)
    rows = conversation(rng, 1, 3000)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    marks = conversations.marked(conversations.stored(conversations.damaged(df)))
    parts = conversations.blocks(marks, block=100)
    assert parts.count() >= 28 and parts.agg(F.max(F.length(F.get("letters", F.lit(0))))).first()[0] <= 400
    got = conversations.audited(conversations.damaged(df), block=100).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == brute(rows)


def test_empty_and_dropped(spark):
    df = table(spark, [(1, 1, "user", "x")])
    assert conversations.audited(conversations.damaged(df.limit(0))).count() == 0
    gone = conversations.audited(df.select("conv_id", "turn", "role", "text", F.lit(True).alias("gone"))).collect()
    assert [tuple(r) for r in gone] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_far_turns(spark):
    rows = [(1, -2**63, "user", "a."), (1, 2**63 - 1, "assistant", "b.")]
    got = conversations.audited(table(spark, rows)).first()
    assert got["gaps"] is None and got["audit"] == "KK"


def test_prefixes_compare_like_strings():
    rng, tree, nodes = random.Random(4), conversations.Prefixes(), {"": 0}
    for _ in range(400):
        s = rng.choice(list(nodes)) + rng.choice("DIKR")
        nodes[s] = tree.extend(nodes[s[:-1]], ord(s[-1]))
        assert tree.extend(nodes[s[:-1]], ord(s[-1])) == nodes[s]
    for _ in range(2000):
        a, b = rng.choice(list(nodes)), rng.choice(list(nodes))
        assert tree.less(nodes[a], nodes[b]) == (a < b)
    assert tree.collisions == 0


def test_colliding_hashes_change_nothing(monkeypatch):
    monkeypatch.setattr(conversations.Prefixes, "mixed", lambda self, value, symbol: symbol % 2)
    test_prefixes_like = conversations.Prefixes()
    a, b = test_prefixes_like.extend(0, ord("D")), test_prefixes_like.extend(0, ord("K"))
    long_a, long_b = test_prefixes_like.extend(a, ord("R")), test_prefixes_like.extend(b, ord("R"))
    assert test_prefixes_like.less(long_a, long_b) and not test_prefixes_like.less(long_b, long_a)
    rng = random.Random(6)
    for _ in range(30):
        rows = [(0, rng.choice(ROLES) or "", "Yes.") for _ in range(8)]
        coded = [({"s": 1, "u": 2, "a": 3}.get(r[:1], 0), 0) for _, r, _ in rows]
        assert conversations.audit(coded) == cheapest(rows, [""] * 8, Costs())[:2]
