"""The conversation trie against a plain one in Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from quarry.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string, depth string, ka double, part string, n_convs string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:30]


def convs_of(rows):
    convs = defaultdict(list)
    for c, turn, role, text in (r[:4] for r in rows):
        if c is not None:
            convs[c].append((turn is not None, turn, digest(role or "", text or ""), role or "", text or ""))
    return {c: [(x[3], x[4]) for x in sorted(v, key=lambda x: (x[0], x[1] or 0, x[2]))] for c, v in convs.items()}


def regrouped(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def brute(convs):
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        words = len(re.findall("[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(who) - 1) * words
    return sorted((min(w), len(k), min(members[k[:-1]]) if k else -1, len(w), len(kids[k]), leaves[k], saved[k],
                   hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, w in members.items())


def run(df, **options):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in map(tuple, ct.conversation_trie(df, **options).collect()))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", 1.5, "p", "n") for r in rows], SCHEMA).repartition(5)


def messy_turns(seed=1, n=60, longest=9):
    r = random.Random(seed)
    says = ["hi", "hi there", "a b c", "", None, " x\ty ", "ok ok"]
    rows = []
    for c in range(n):
        for t in range(r.randint(1, longest)):
            rows.append((c, t, r.choice(["user", "assistant"]) if t > 2 else "user", r.choice(says[: 2 if t < 3 else 7])))
    rows += [(61, None, None, None), (61, 1, "user", "tie"), (61, 1, "user", "other"), (61, 1, "user", "tie"), (None, 1, "user", "x"),
             (None, None, None, None), (85, 0, "user", "hi"), (99, 0, "user", "w " * 50_000), (62, None, "user", "hi"), (62, 0, "user", "hi")]
    return rows


@pytest.mark.parametrize("regroup", [False, True])
def test_messy_turns(spark, regroup):
    rows = messy_turns()
    convs = convs_of(rows)
    assert run(frame(spark, rows), regroup=regroup) == brute(regrouped(convs) if regroup else convs)


@pytest.mark.parametrize("band", [2, 3])
def test_bands_of_bands(spark, monkeypatch, band):
    """Long conversations over small bands and blocks: several levels of recursion."""
    monkeypatch.setattr(ct, "BAND", band)
    monkeypatch.setattr(ct, "BLOCK", 4)
    r = random.Random(3)
    rows = [(c, t, "user", f"{t} say" if t < stop else f"{c} x y") for c in range(12) for stop in [r.randint(0, 30)] for t in range(r.randint(1, 31))]
    rows += [(c, t, "user", f"{t} say") for c in (50, 51, 60) for t in range(27)]
    convs = convs_of(rows)
    assert run(frame(spark, rows), regroup=True) == brute(regrouped(convs))


def test_many_equal_conversations(spark, monkeypatch):
    """Ends of one node in many pieces; one conversation with most of the turns."""
    monkeypatch.setattr(ct, "PIECE", 7)
    rows = [(c, t, "user", f"same {t}") for c in range(300) for t in range(2)] + [(1000, t, "user", f"long {t % 3}") for t in range(400)]
    assert run(frame(spark, rows)) == brute(convs_of(rows))


def test_turnless_after_regrouping(spark):
    """No leader: the first h own turns are lost and the root has ends."""
    rows = [(c, 0, "user", "only") for c in range(21, 40)]
    got = run(frame(spark, rows), regroup=True)
    assert got == brute(regrouped(convs_of(rows)))
    assert got[0][1] == 0 and got[0][7] != hashlib.sha256().hexdigest()


def test_empty(spark):
    assert run(frame(spark, [])) == [] == run(frame(spark, [(None, 1, "user", "x")]), regroup=True)
