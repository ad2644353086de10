"""Conversation repair against a plain search over all runs of edits."""

import hashlib
import itertools
import re
import zlib
from functools import lru_cache

import pytest

from meshflux.llm import conversations, queries, repair_path
from tests.llm.conftest import turns

SOLID = re.compile(r"[^\x20\x09-\x0D]")
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        solid = SOLID.findall(text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, repaired) by forward search over (row, initials so far): all runs of edits of bounded cost, the least by cost and letters."""
    n = len(rows)

    @lru_cache(None)
    def best(k, last):
        """Least (cost, letters, turns) from row k on; last is the initial before, '' at the start."""
        return min(options(k, last, 2), key=lambda o: (o[0], o[1]))

    def forced(last):
        return "user" if last in ("", "s", "a") else "assistant"

    def options(k, last, inserts):
        out = []
        if k == n and last in ("", "a"):
            out.append((0, "", ()))
        if inserts:
            role = forced(last)
            more = min(options(k, role[0], inserts - 1), key=lambda o: (o[0], o[1]))
            out.append((more[0] + 2, "I" + more[1], (f"{role}:", *more[2])))
        if k < n:
            _, _, role, text = rows[k]
            rest = best(k + 1, last)
            out.append((rest[0] + 3, "D" + rest[1], rest[2]))
            if found[k] not in ("blank", "duplicate"):
                more = int(found[k] == "truncated")
                for to, letter, price in ((role, "K", 0), (forced(last), "R", 2)):
                    i = to[:1]
                    if (last, i) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                        rest = best(k + 1, i)
                        out.append((rest[0] + price + more, letter + rest[1], (f"{to}:{text}", *rest[2])))
        return out or [(10**9, "~", ())]

    return best(0, "")


def summary(rows):
    rows = damage(rows)
    found = faults(rows)
    numbers = {r[1] for r in rows if r[1] is not None}
    initials = [r[2][:1] for r in rows]
    cost, audit, lines = cheapest(tuple(rows), tuple(found))
    return (
        max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, found.count("blank"), found.count("duplicate"), found.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_whole_table(spark, folder, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE", 1000)
    rows = [t[:4] for t in turns()]
    got = {r.conv_id: tuple(r)[1:] for r in queries.QUERIES["op12_conversation_repair"](spark, folder).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv in sorted(got, key=str):
        own = [r for r in rows if r[0] == conv]
        if len(own) < 500:
            assert got[conv] == summary(own), conv
    # The long one: its audit gives its cost, and a plain run of the same programme in one piece agrees.
    own = damage([r for r in rows if r[0] == 500])
    found = faults(own)
    codes = [repair_path.code(r[2][:1], (None, "blank", "duplicate", "truncated").index(f)) for r, f in zip(own, found, strict=True)]
    assert got[500][5] == repair_path.start(codes, repair_path.END)[0]
    assert got[500][1:4] == tuple(found.count(f) for f in ("blank", "duplicate", "truncated"))
    letters, state = "", 0
    for inserted, edit, state in repair_path.walk(codes, repair_path.END, 0):
        letters += "I" * len(inserted) + edit
    assert got[500][6] == letters + "I" * len(repair_path.ending(state))


@pytest.mark.parametrize("roles", ["".join(p) for n in range(1, 6) for p in itertools.product("suax", repeat=n) if n < 4 or p[0] < p[-1]][:400:3])
def test_small_conversations(roles):
    """Cost and letters of every short run of roles, each with a fault in turn; blocks joined by their matrices agree."""
    for fault in range(4):
        found = [(None, "blank", "duplicate", "truncated")[fault if k == len(roles) // 2 else 0] for k in range(len(roles))]
        rows = tuple((1, k, {"s": "system", "u": "user", "a": "assistant", "x": "tool"}[r], f"t{k}") for k, r in enumerate(roles))
        cost, audit, _ = cheapest(rows, tuple(found))
        codes = [repair_path.code(r, (None, "blank", "duplicate", "truncated").index(f)) for r, f in zip(roles, found, strict=True)]
        letters, state = "", 0
        for inserted, edit, state in repair_path.walk(codes, repair_path.END, 0):
            letters += "I" * len(inserted) + edit
        letters += "I" * len(repair_path.ending(state))
        assert (repair_path.start(codes, repair_path.END)[0], letters) == (cost, audit)
        cut = len(codes) // 2
        end = repair_path.applied(repair_path.matrix(codes[cut:]), repair_path.END)
        assert repair_path.applied(repair_path.matrix(codes[:cut]), end)[0] == cost
