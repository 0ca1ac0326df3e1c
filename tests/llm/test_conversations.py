"""Conversation repair against every way to edit short conversations, and long ones cut into leaves against whole ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from plumbline.llm import conversations as C
from plumbline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def faults(turns):
    """(role, text, fault) of (role, text) in order."""
    seen, out = set(), []
    for role, text in turns:
        marks = [c for c in text if c not in " \t\n\r\x0b\x0c"]
        fault = "blank" if not marks else "duplicate" if (role, text) in seen else "" if marks[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def every_way(turns):
    """The cheapest repair of a short conversation, by trying all edits: (cost, audit, lines)."""
    inserts = [(0, "", [])] + [(3 * n, "I" * n, [(x, "") for x in w]) for n in (1, 2, 3) for w in itertools.product(("user", "assistant"), repeat=n)]
    slots = [inserts]
    for role, text, fault in faults(turns):
        extra = 3 * (fault == "truncated")
        ways = [(4, "D", [])]
        if fault not in ("blank", "duplicate"):
            ways += [(extra, "K", [(role, text)])] + [(3 + extra, "R", [(x, text)]) for x in ("user", "assistant")]
        slots += [ways, inserts]
    best = None
    for way in itertools.product(*slots):
        lines = [x for w in way for x in w[2]]
        if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in lines)):
            key = (sum(w[0] for w in way), "".join(w[1] for w in way))
            if best is None or key < best[0]:
                best = (key, lines)
    return *best[0], [f"{r}:{t}" for r, t in best[1]]


def by_states(turns):
    """As every_way for any length: the best way to each state, one turn after the other."""
    steps = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def inserted(now):
        for _ in range(3):
            for s, (cost, audit, lines) in list(now.items()):
                for role in ("user", "assistant"):
                    if (s, role[0]) in steps:
                        to, way = steps[s, role[0]], (cost + 3, audit + "I", (*lines, f"{role}:"))
                        now[to] = min(now.get(to, way), way, key=lambda w: w[:2])
        return now

    now = inserted({"": (0, "", ())})
    for role, text, fault in faults(turns):
        extra, after = 3 * (fault == "truncated"), {}
        for s, (cost, audit, lines) in now.items():
            ways = [(s, (cost + 4, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                ways += [(steps.get((s, r[:1])), (cost + c + extra, audit + x, (*lines, f"{r}:{text}"))) for r, c, x in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R"))]
            for to, way in ways:
                if to is not None:
                    after[to] = min(after.get(to, way), way, key=lambda w: w[:2])
        now = inserted(after)
    cost, audit, lines = min((now[s] for s in ("", "a") if s in now), key=lambda w: w[:2])
    return cost, audit, list(lines)


def drawn(r, n):
    return [(r.choice(["user", "assistant", "system", "", "tool"]), r.choice(["a.", "b?", "c", " ", "", "a. ", "d!\n"])) for _ in range(n)]


def test_states_equal_every_way():
    r = random.Random(3)
    for _ in range(60):
        turns = drawn(r, r.randint(0, 2))
        assert by_states(turns) == every_way(turns), turns


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_repair(spark, block, monkeypatch):
    r = random.Random(block)
    talks = {c: drawn(r, r.choice([0, 1, 2, 5, 9])) for c in range(60)} | {60: drawn(r, 300), None: drawn(r, 7)}
    rows = [(c, i if i % 5 else None if i == 0 else i, role, text, 1, False) for c, t in talks.items() for i, (role, text) in enumerate(t)]
    rows += [(c, 0, "user", "x.", 1, True) for c, t in talks.items() if not t]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies int, gone boolean")
    scan = C.scan
    monkeypatch.setattr(C, "scan", lambda t: scan(t, block=block))
    got = C.repair(df).collect()
    assert len(got) == len(talks)
    for g in got:
        turns = talks[g["conv_id"]]
        cost, audit, lines = by_states(turns)
        assert (g["cost"], g["audit"]) == (cost, audit), (turns, g)
        assert g["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        told = [f for _, _, f in faults(turns)]
        assert [g["blank"], g["duplicate"], g["truncated"]] == [told.count(x) for x in ("blank", "duplicate", "truncated")]
        assert g["illegal"] == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        assert g["gaps"] == 0


def whole_query(rows):
    """The contract row by row: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, digest)."""
    talks = {}
    for conv, turn, role, text in rows:
        shown = [" " if x is None else x for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = ("user" if kind == 4 else shown[2]), ("" if kind == 1 else re.sub("[.!?]", "", shown[3]) if kind == 2 else shown[3])
        talks.setdefault(conv, []).extend([(turn is not None, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    for conv, turns in talks.items():
        turns.sort(key=lambda t: (t[0], t[1] or 0, t[2], t[3]))
        told = [f for _, _, f in faults([t[2:] for t in turns])]
        numbers = [t[1] for t in turns if t[0]]
        cost, audit, lines = by_states([t[2:] for t in turns])
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        yield (conv, gaps, *(told.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    got = QUERIES["op12_conversations"](spark, SF)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(whole_query([tuple(r) for r in rows]))


def test_edges(spark):
    schema = "conv_id long, turn long, role string, text string, leaf long, said string, copies string"
    rows = [(1, None, None, None), (1, None, None, None), (1, 3, "user", "a."), (1, 3, "user", "a."), (1, 9, "assistant", "b " * 700_000 + "."), (None, 1, "user", "q?"), (None, None, "user", "q?"), (2, 1, "", "")]
    df = spark.createDataFrame([(*x, 1, "s", "z") for x in rows], schema).drop("copies")
    want = sorted(whole_query(rows), key=str)
    assert sorted(map(tuple, C.repair(C.damaged(df)).collect()), key=str) == want
    assert C.repair(C.damaged(df.limit(0))).collect() == []
