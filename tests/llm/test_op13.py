"""Conversation repair against brute force over all cheap edits."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest

from precedent.llm import op13_conversations as op13

SCHEMA = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def brute(rows, damaged=True):
    """{conv_id: result} by a search forward over rows, with the repaired text carried along."""
    out, by = {}, {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        by[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, rs in by.items():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in rs:
            chars = WORD.findall(text)
            faults.append("b" if not chars else "d" if (role, text) in seen else "t" if chars[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in rs if t is not None}
        initials = [r[1][:1] for r in rs]

        def step(state, initial):
            ok = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
            return initial if initial and initial in ok else None

        now = {"": (0, "", ())}
        for (_, role, text), fault in [*zip(rs, faults), ((None, None, None), None)]:
            for _ in range(3):                  # put rows in, as often as it may help
                for st, (c, a, t) in list(now.items()):
                    for ini, name in (("u", "user"), ("a", "assistant")):
                        if step(st, ini):
                            new = (c + 2, a + "I", t + (f"{name}:",))
                            now[ini] = min(now.get(ini, new), new, key=lambda x: x[:2])
            if fault is None:
                break
            after = {}

            def offer(st, c, a, t):
                after[st] = min(after.get(st, (c, a, t)), (c, a, t), key=lambda x: x[:2])
            for st, (c, a, t) in now.items():
                offer(st, c + 3, a + "D", t)
                if fault in ("", "t"):
                    c += fault == "t"
                    if step(st, role[:1]):
                        offer(role[0], c, a + "K", t + (f"{role}:{text}",))
                    for ini, name in (("u", "user"), ("a", "assistant")):
                        if step(st, ini):
                            offer(ini, c + 2, a + "R", t + (f"{name}:{text}",))
            now = after
        cost, audit, lines = min((now[s] for s in ("", "a") if s in now), key=lambda x: x[:2])
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"),
                     faults.count("t"), sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:])),
                     cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def table(spark, rows, partitions=4):
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def random_rows(rng, n):
    rows = []
    for conv in range(n):
        turn = rng.choice([0, 5])
        for _ in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, "", "User"])
            text = rng.choice(["Hi.", "ok", "What?", "", None, " \t", "Well! ", "é", "x ", f"n{rng.random()}."])
            rows.append((conv, rng.choice([turn, None] if rng.random() < 0.1 else [turn]), role, text))
            turn += rng.choice([0, 1, 1, 1, 3])
    return rows


@pytest.mark.parametrize("damaged", [True, False])
def test_repairs_equal_brute_force(spark, damaged):
    rows = random_rows(random.Random(13), 400) + [(None, 1, "user", "No id."), (None, 2, "assistant", "Yes."),
                                                  (7000, None, None, None), (7001, None, "user", "a.")]
    rows += [(8000 + i, t, r, x) for i in range(60) for t, r, x in ((0, "user", "Same."), (1, "assistant", "Same!"))]
    got = result(op13.repair(table(spark, rows), damaged))
    assert got == brute(rows, damaged)
    assert len({v[6] for v in got.values()}) > 50


def test_dropped_conversations_have_zeros(spark):
    rows = [(c, 0, "user", "x.") for c in range(200)]
    dropped = [c for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = result(op13.repair(table(spark, rows), True))
    assert dropped and all(got[c] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in dropped)


def test_automaton_takes_the_least_audit():
    """All audits of up to two rows put in at each place, tried one by one."""
    letters = "".join(map(op13.letter, range(16)))
    words = sorted(["".join(w) for n in range(4) for w in itertools.product(letters[::3] + letters[5], repeat=n)],
                   key=lambda w: w[::-1])
    automaton = op13.Automaton()

    @functools.lru_cache(None)
    def tries(n):
        puts = ["", "I", "II"]
        if n == 0:
            return puts
        return [p + e + rest for p in puts for e in "DKR" for rest in tries(n - 1)]

    def cost(word, audit):
        state, total, i = op13.START, 0, 0
        for e in audit:
            role, fault = None, 0
            if e != "I":
                role, fault = divmod(ord(word[i]) - ord("A"), 4)
                i += 1
            total += {"I": 2, "D": 3, "K": 0, "R": 2}[e]
            if e == "D":
                continue
            if fault in (op13.BLANK, op13.DUPLICATE):
                return None
            total += fault == op13.CUT
            if e == "K":
                state = op13.ARCS[state].get(op13.ROLES[role])
            else:
                state = next(to for r, to in op13.ARCS[state].items() if r != "s")
            if state is None:
                return None
        return total if state in op13.ENDS else None

    for word in words:
        want = min((c, a) for a in tries(len(word)) if (c := cost(word, a)) is not None)
        assert automaton.repair(word) == want
    assert len(automaton.values) < 60 and len(automaton.register) < 60 * 16


def test_long_conversation_spreads_and_odd_tables(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}.") for t in range(3000)] + [(2, 0, "user", "a.")]
    rows += [(1, 10, "user", "t10.")] * 500                 # equal rows
    df = table(spark, rows).selectExpr("*", "1 as th", "'x' as audit", "2 as copies", "3 as code")
    got = result(op13.repair(df, True))
    assert got == brute(rows)
    parts = op13.signatures(op13.lettered(op13.damage(df)))
    assert {r.conv_id: len(r.signature) for r in parts.collect()}[1] > 2800
    assert op13.repair(df.limit(0), True).count() == 0
