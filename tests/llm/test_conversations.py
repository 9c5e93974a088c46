"""Conversation repair against brute force, and its edge cases."""

import hashlib
import random
import re
import zlib

import pytest

from pagetone.llm import conversations as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def kind(conv, turn):
    shown = [" " if x is None else str(x) for x in (conv, turn)]
    return zlib.crc32(":".join(shown).encode()) % 20


def cheapest(rows):
    """Every edit sequence with up to two Inserts at a place; rows are (initial, must_delete, truncated, (role, text))."""
    best = None

    def go(i, roles, cost, audit, lines):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, lines)
        if not audit.endswith("II"):
            for role in ("user", "assistant"):
                go(i, roles + role[0], cost + 5, audit + "I", [*lines, f"{role}:"])
        if i == len(rows):
            return
        initial, must_delete, truncated, (own, text) = rows[i]
        go(i + 1, roles, cost + 2, audit + "D", lines)
        if not must_delete:
            pay = 5 if truncated else 0
            if initial:  # an empty role fits no place
                go(i + 1, roles + initial, cost + pay, audit + "K", [*lines, f"{own}:{text}"])
            for role in ("user", "assistant"):
                go(i + 1, roles + role[0], cost + pay + 1, audit + "R", [*lines, f"{role}:{text}"])

    go(0, "", 0, "", [])
    return best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest()


def test_edits_like_every_sequence():
    chance = random.Random(7)
    for _ in range(150):
        rows = []
        for i in range(chance.randrange(5)):
            role = chance.choice(["system", "user", "assistant", "user", "assistant", "tool", " "])
            rows.append((role[:1], chance.random() < 0.2, chance.random() < 0.3, (role, f"t{i}")))
        assert C.repaired(rows) == cheapest(rows)


def test_memory_holds_the_undecided_suffix_only():
    paths, most = C.Survivors(C.EMPTY, lambda *edit: None), 0
    paths.inserts()
    chance = random.Random(1)
    for i in range(5000):
        role = ("user", "assistant")[i % 2]
        paths.row(role[0], chance.random() < 0.1, chance.random() < 0.1, (role, "x"))
        most = max(most, len(paths.up))
    assert most < 200


def by_hand(rows):
    """{conv_id: result} straight from the contract."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            k = kind(conv, turn)
            if k == 0:
                continue
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            kept += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, count, steps = set(), dict.fromkeys(C.FAULTS, 0), []
        for _, role, text in kept:
            bare = text.rstrip(" \t\n\x0b\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            if fault:
                count[fault] += 1
            steps.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated", (role, text)))
        turns = [t for t, *_ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [s[0] for s in steps]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, *count.values(), illegal, *cheapest(steps))
    return out


@pytest.fixture(scope="module")
def odd_rows():
    rows = [(None, 1, "user", "hello."), (None, None, "assistant", "no turn."), (1, None, None, None), (1, 2, "user", None),
            (1, 2, "user", "tie b."), (1, 2, "user", "tie a."), (1, 2, "assistant", "tie a."), (3, 2**60 + 1, "user", "far."),
            (3, 2**60 + 5, "assistant", "farther."), (4, 1, "system", "s."), (4, 2, "user", "q?"), (4, 3, "user", "q?"), (4, 9, "assistant", "cut")]
    rows += [(10, 1, "", "no role."), (10, 2, "user", "x. \t\n"), (10, 3, "assistant", "\x0b\x0c")]
    dropped = next(c for c in range(100, 1000) if kind(c, 0) == 0)
    twice = next(c for c in range(100, 1000) if kind(c, 0) == 3)
    return [*rows, (dropped, 0, "user", "gone."), (twice, 0, "user", "twice."), (twice, 1, "assistant", "once.")]


def test_odd_rows(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, SCHEMA).selectExpr("*", "1 AS fault", "2 AS repeats", "3 AS __kind")
    got = {r[0]: tuple(r)[1:] for r in C.repair(df).collect()}
    assert got == by_hand(odd_rows)


def test_hot_conversation_like_the_contract(spark):
    rows = [(5, t, ("user", "assistant")[t % 2], f"line {t % 37}." if t % 5 else "cut") for t in range(400)]
    got = C.repair(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 1 and got[0]["duplicate"] > 100 and set(got[0]["audit"]) <= set("KRDI")


def test_no_rows(spark):
    out = C.repair(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns[-1] == "repaired_sha256"


def test_very_long_text(spark):
    rows = [(1, 5, "user", "word " * 200_000 + "end."), (1, 6, "assistant", "ok.")]
    assert {r[0]: tuple(r)[1:] for r in C.repair(spark.createDataFrame(rows, SCHEMA)).collect()} == by_hand(rows)
