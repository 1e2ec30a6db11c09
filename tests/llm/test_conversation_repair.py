"""Conversation repair against brute force and SQL, and odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import duckdb
import pyarrow as pa

from veritrove.llm import conversation_repair
from veritrove.llm.conversation_repair import damage_and_repair, repaired_turns
from veritrove.llm.oracles import ORACLES

NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SPACE = " \t\n\x0b\x0c\r"
LEGAL = re.compile("(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        body = text.rstrip(SPACE)
        out.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best_edits(turns):
    """Least cost and audit by the best ends, from the last turn back, with the repaired turns."""
    flags = faults(turns)
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    @lru_cache(None)
    def rest(k, state, free):
        found = []
        if k == len(turns) and state in (0, 3):
            found.append((0, "", ()))
        if free:
            for r, name in (("u", "user"), ("a", "assistant")):
                if (state, r) in after:
                    c, a, t = rest(k, after[state, r], free - 1)
                    found.append((c + 2, "I" + a, (name + ":", *t)))
        if k < len(turns):
            _, role, text = turns[k]
            c, a, t = rest(k + 1, state, 2)
            found.append((c + 3, "D" + a, t))
            if flags[k] in ("", "t"):
                for r, name, cost, letter in ((role[:1], role, 0, "K"), ("u", "user", 2, "R"), ("a", "assistant", 2, "R")):
                    if (state, r) in after:
                        c, a, t = rest(k + 1, after[state, r], 2)
                        found.append((c + cost + (flags[k] == "t"), letter + a, (f"{name}:{text}", *t)))
        return min(found, default=(10**9, "", ()))

    for k in range(len(turns), 0, -40):  # from the end, as Python's stack is short
        for state in range(4):
            rest(k, state, 2)
    return rest(0, 0, 2)


def all_edits(turns):
    """The same by trying everything; for a few turns."""
    flags, best = faults(turns), None
    inserts = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    options = [[("D", None)] + ([] if f in "bd" and f else [("K", r[:1]), ("R", "u"), ("R", "a")]) for (_, r, _), f in zip(turns, flags)]
    for edits in itertools.product(*options):
        for gaps in itertools.product(inserts, repeat=len(turns) + 1):
            initials, audit, cost = "", "", 0
            for k, gap in enumerate(gaps):
                initials, audit, cost = initials + "".join(gap), audit + "I" * len(gap), cost + 2 * len(gap)
                if k < len(turns):
                    letter, r = edits[k]
                    audit += letter
                    cost += {"D": 3, "K": 0, "R": 2}[letter] + (letter != "D" and flags[k] == "t")
                    initials += r if r is not None else ""
                    if r == "":
                        initials += "?"
            if LEGAL.fullmatch(initials) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def brute(rows):
    convs = {r[0]: [] for r in rows}
    for conv, *turn in damage(rows):
        convs[conv].append(tuple(turn))
    out, kept = set(), {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.sha256(t[2].encode()).digest()))
        numbers = [t[0] for t in turns if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        f = faults(turns)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, repaired = best_edits(turns)
        if len(turns) <= 3:
            assert (cost, audit) == all_edits(turns)
        kept[conv] = repaired
        out.add((conv, gaps, f.count("b"), f.count("d"), f.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return out, kept


def planted(r):
    rows = []
    texts = ["Yes.", "No!", "why?", "open end", "", "  \n", "é漢🙂.", "Yes. ", "x" * 5_000 + ".", None]
    for conv in [*range(90), None, -5]:
        n = r.randint(0, 3) if r.random() < 0.5 else r.randint(4, 12)
        names = r.choice([["user", "assistant"], ["system", "user", "assistant"], ["user"], ["assistant", "user", "tool", "", None]])
        turn = 0
        for k in range(n):
            turn += r.choice([1, 1, 1, 2, 0])
            rows.append((conv, turn if r.random() < 0.95 else None, names[k % len(names)] if r.random() < 0.8 else r.choice(names), r.choice(texts) if r.random() < 0.4 else f"Turn {r.randint(0, 9)} of it."))
    rows += [(1000, k, "user" if k % 2 == 0 else "assistant", f"t{k % 700}" + "." * (k % 3 > 0)) for k in range(900)]  # many blocks
    rows += [(1001, None, None, None)] * 3
    dropped = next(c for c in range(2000, 3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, (dropped, 0, "user", "gone.")]


def test_against_brute_force(spark, monkeypatch):
    rows = planted(random.Random(4))
    d = spark.createDataFrame([(*r, "a", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, block int").repartition(6)
    want, kept = brute(rows)
    assert len({r[7] for r in want}) > 40
    monkeypatch.setattr(conversation_repair, "MOST_BLOCKS", 3)  # blocks are composed level by level
    assert {tuple(x) for x in damage_and_repair(d).select(*NAMES).collect()} == want
    turns = {}
    for x in repaired_turns(d).collect():
        turns.setdefault(x.conv_id, {})[x.place] = f"{x.role}:{x.text}"
    assert {c: tuple(t[k] for k in range(len(t))) for c, t in turns.items()} == {c: t for c, t in kept.items() if t}


def test_against_sql(spark):
    rows = [x for x in planted(random.Random(5)) if x[0] != 1000]
    # one turn's rows in the order that both take: texts in the order of their hashes too
    seen, distinct = set(), []
    for x in rows:
        if x[:2] not in seen:
            seen.add(x[:2])
            distinct.append(x)
    con = duckdb.connect()
    con.register("conversations", pa.table({n: pa.array([x[k] for x in distinct], t) for k, (n, t) in enumerate((("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())))}))
    found = con.sql(ORACLES["op12_conversation_repair"])
    assert found.columns == NAMES
    want, _ = brute(distinct)
    assert set(found.fetchall()) == want
    got = damage_and_repair(spark.createDataFrame(distinct, "conv_id long, turn long, role string, text string"))
    assert {tuple(x) for x in got.select(*NAMES).collect()} == want


def test_empty(spark):
    assert damage_and_repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
