"""Conversation repair against all possible edits, tried one by one."""

import hashlib
import itertools
import random

import pytest

from srcweave.llm import conversation_repair as R

SCHEMA = "conv_id long, turn long, role string, text string"
TEXTS = ["fine.", "fine.", "cut", " ", "", None, "other!", "more words here", "é?\n "]
ROLES = ["user", "assistant", "system", "user", "assistant", "tool", None, ""]


def _faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        core = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def _plain(rows):
    """The contract's columns of one conversation's rows (turn, role, text), by trying every edit of every row."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, best = _faults(rows), None
    for edits in itertools.product(*[[i + e for i in ("", "I", "II") for e in ("D" if f in ("blank", "duplicate") else "DKR")] for f in faults], ["", "I", "II"]):
        audit, cost, out, spoken, at, good = "".join(edits), 0, [], 0, 0, True
        for e in audit:
            role, text, f = ("", "", "") if e == "I" else (*rows[at][1:], faults[at])
            at += e != "I"
            cost += {"D": 2, "K": 0, "R": 1, "I": 5}[e] + (5 if f == "truncated" and e != "D" else 0)
            if e == "D":
                continue
            want = "ua"[spoken % 2]
            if e == "K":
                good &= role[:1] == want or role[:1] == "s" and not out
                spoken += role[:1] != "s"
            else:
                role = {"u": "user", "a": "assistant"}[want]
                spoken += 1
            out.append(f"{role}:{text}")
        good &= spoken % 2 == 0 and (spoken > 0 or not out)
        if good and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    first = [r[1][:1] for r in rows]
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False)), *best)


def _tables():
    dice = random.Random(5)
    out = {k: [(dice.choice([None, 0, 1, 1, 2, 3, 7]), dice.choice(ROLES), dice.choice(TEXTS)) for _ in range(dice.randint(1, 4))] for k in range(60)}
    out[None] = [(0, "user", "no id."), (1, "assistant", "none.")]
    out[100] = [(0, "system", "s."), (1, "user", "u."), (2, "assistant", "a."), (2, "assistant", "a.")]
    out[101] = [(9, "user", "later."), (5, "assistant", "x."), (5, "user", "later.")]
    out[102] = [(-4, "user", "a."), (5000, "assistant", "b."), (2000, "user", "a."), (1500, "user", "c.")]
    return out


@pytest.mark.parametrize(("turns", "batch"), [(1024, 4096), (1, 4096), (2, 3), (1024, 2)])
def test_cheapest_edits(spark, monkeypatch, turns, batch):
    monkeypatch.setattr(R, "BATCH", batch)
    tables = _tables()
    rows = [(c, *r) for c, some in tables.items() for r in some]
    random.Random(1).shuffle(rows)
    got = {r[0]: tuple(r)[1:] for r in R.repair(spark.createDataFrame(rows, SCHEMA), turns=turns).collect()}
    assert got == {c: _plain(some) for c, some in tables.items()}


def test_long_conversation_in_units(spark):
    """Units fold to what one walk gives."""
    dice = random.Random(3)
    rows = [(1, t, dice.choice(["user", "assistant", "system"]), f"t{dice.randint(0, 900)}" + dice.choice([".", ""])) for t in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    some, whole = R.repair(df, turns=64).first(), R.repair(df, turns=10_000).first()
    assert some == whole and len(some.audit) == 3000


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "a. b!") for c in range(40) for t in range(4)] + [(None, None, None, None)]
    got = sorted(map(tuple, R.damage(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    want = []
    for c, t, role, text in rows:
        op = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        want += [(c, t, "user" if op == 4 else role, "" if op == 1 else text.translate({46: None, 33: None}) if op == 2 else text)] * (0 if op == 0 else 2 if op == 3 else 1)
    assert got == sorted(want, key=str)


def test_none_left_empty_and_clashing(spark):
    df = spark.createDataFrame([(1, 0, "user", "x.", "z")], SCHEMA + ", piece string").withColumnRenamed("piece", "conv")
    ids = spark.createDataFrame([(1,), (2,), (2,)], "conv_id long")
    got = {r.conv_id: r for r in R.repair(df.selectExpr("*", "1 as h", "2 as kind"), ids).collect()}
    assert got[1].audit == "D" and got[2] == (2, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert R.repair(df.where("false")).collect() == [] and R.repair(df.where("false"), ids.where("false")).collect() == []


def test_very_long_texts(spark, monkeypatch):
    """Texts that fill a batch by themselves."""
    monkeypatch.setattr(R, "BATCH_BYTES", 1 << 20)
    rows = [(c, t, ("user", "assistant")[t % 2], f"{c} {t} " + "x" * 700_000 + ".") for c in range(3) for t in range(4)]
    got = {r.conv_id: r for r in R.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    for c in range(3):
        told = "\n".join(f"{r}:{x}" for k, _, r, x in rows if k == c)
        assert (got[c].audit, got[c].cost, got[c].repaired_sha256) == ("KKKK", 0, hashlib.sha256(told.encode()).hexdigest())
