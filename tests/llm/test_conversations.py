import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from quarry.llm import conversations as cv

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def shown(x):
    return " " if x is None else str(x)


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = shown(role), shown(text)
        fault = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            yield from [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)


def repaired(rows):
    """Faults, then the least (cost, audit) by keeping the best of every state after each row."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
    seen, faults, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
        if fault:
            count[fault] += 1
    turns = {r[1] for r in rows if r[1] is not None}

    def insert(best):
        for _ in range(3):
            for s, (cost, audit, out) in list(best.items()):
                for initial, role in (("u", "user"), ("a", "assistant")):
                    to = NEXT.get((s, initial))
                    if to is not None and (cost + 2, audit + "I") < best.get(to, (1 << 60, "", ()))[:2]:
                        best[to] = (cost + 2, audit + "I", (*out, f"{role}:"))
        return best

    best = insert({0: (0, "", ())})
    for (_, _, role, text), fault in zip(rows, faults):
        after = {}
        for s, (cost, audit, out) in best.items():
            ways = [(3, "D", s, out)]
            if fault not in ("blank", "duplicate"):
                add = fault == "truncated"
                ways += [(add, "K", NEXT.get((s, role[:1])), (*out, f"{role}:{text}"))]
                ways += [(2 + add, "R", NEXT.get((s, r[0])), (*out, f"{r}:{text}")) for r in ("user", "assistant")]
            for add, letter, to, put in ways:
                if to is not None and (cost + add, audit + letter) < after.get(to, (1 << 60, "", ()))[:2]:
                    after[to] = (cost + add, audit + letter, put)
        best = insert(after)
    cost, audit, out = min(v for s, v in best.items() if s in (0, 3))
    initials = [r[2][:1] for r in rows]
    illegal = sum(p + q not in ("su", "ua", "au") for p, q in zip(initials, initials[1:]))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], [])
    for r in damaged(rows):
        by[r[0]].append(r)
    return {c: repaired(rs) if rs else (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c, rs in by.items()}


def talk(rng, conv, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "system", "u", "alien"]
    texts = ["Hello.", "Hello?", "no stop", " ", "", None, "Fine!\n", "　.", "é 漢.", "Hello.  x", " "]
    good = ["user", "assistant"]
    return [(conv, None if rng.random() < 0.05 else rng.randint(0, n + 2) if rng.random() < 0.2 else i, good[i % 2] if rng.random() < 0.6 else rng.choice(roles), rng.choice(texts) if rng.random() < 0.3 else f"Text {i}.") for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [r for c in range(120) for r in talk(rng, c, rng.randint(1, 9))]
    out += talk(rng, 500, 300) + [r for r in talk(rng, None, 12)]
    out += [(600, 3, "user", "Same.")] * 40 + [(601, None, "system", "Rule.")] + [(602, -(2**63), "user", "a."), (602, 2**63 - 1, "assistant", "b.")]
    out += [(603, i, "user", "x" * 200_000 + ".") for i in range(3)]
    return out


@pytest.mark.parametrize("limit", [3, 1024])
def test_report_equals_brute_force(spark, rows, limit):
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, c string, seg int").repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in cv.repair_report(df, cv.damage(df), limit).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for c in want:
        w = want[c]
        assert got[c] == (w if -(2**63) <= w[0] < 2**63 else (None, *w[1:])), c


def test_turns_are_legal(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    by = {}
    for r in cv.Repair(df, 4).turns().collect():
        by.setdefault(r.conv_id, []).append((r.position, r.role[:1], r.text, r.inserted))
    for turns in by.values():
        turns.sort()
        assert [p for p, *_ in turns] == list(range(len(turns)))
        assert re.fullmatch("(s?(ua)+)?", "".join(t[1] for t in turns))
        assert all(t[2] == "" for t in turns if t[3])


def test_audit_is_least_of_all_strings():
    """Against every string of edits of a short conversation."""
    rng = random.Random(2)
    for _ in range(60):
        kinds = [rng.choice([0, 1, 2, 3]) + 4 * rng.randint(0, 1) + 8 * (rng.random() < 0.2) for _ in range(rng.randint(0, 3))]
        found = []
        for edits in itertools.product("DIKR", repeat=0) if not kinds else (e for n in range(len(kinds), len(kinds) + 3) for e in itertools.product("DIKR", repeat=n)):
            state, cost, i = 0, 0, 0
            for e in edits:
                if e == "I":
                    state, cost = int(cv.TURN[state]), cost + 2
                    continue
                if i == len(kinds):
                    break
                k, i = kinds[i], i + 1
                if e == "D":
                    cost += 3
                elif k >= 8:
                    break
                else:
                    state, cost = (int(cv.KEEP[state, k & 3]), cost) if e == "K" else (int(cv.TURN[state]), cost + 2)
                    cost += k >> 2 & 1
                    if state < 0:
                        break
            else:
                if i == len(kinds) and state in (0, 3):
                    found.append((cost, "".join(edits)))
        graph = cv.Graph(np.array([len(kinds)]), np.array(kinds, np.int64), np.ones(len(kinds), np.int64), cv.END[None, :], np.array([True]))
        cost, ways, _ = graph.solve(np.array([0]))
        assert (int(cost[0]), "".join(cv.LETTERS[c] for c, _, _ in ways[0])) == min(found)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cv.repair_report(df, cv.damage(df)).collect() == []
