"""The conversation trie against a plain one."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from conftest import SMALL
from textloom.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, part binary"


def plain(rows):
    """Contract rows from (conv_id, turn, role, text); of equal turns the order is that of digests."""
    digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + ts[h:]
    members = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    out, children = {}, {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    for node in sorted(members, key=len, reverse=True):
        below = [out[x] for x in children.get(node, [])]
        saved = (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        ends = sorted(c for c in members[node] if len(built[c]) == len(node))
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        out[node] = (min(members[node]), len(node), parent, len(members[node]), len(below), sum(b[5] for b in below) or 1, saved + sum(b[6] for b in below), sha)
    return list(out.values())


def check(spark, rows, **sizes):
    got = [tuple(r) for r in trie.trie(spark.createDataFrame([(*r, 1, None) for r in rows], SCHEMA), **sizes).collect()]
    key = lambda r: (r[1], r[0], repr(r))
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


def conversations(seed, convs, alphabet, longest):
    """Random conversations over few different turns, so that many share beginnings, with copies and gaps."""
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        base = rng.choice([c, 3, 3])
        inner = random.Random(base)
        turns = [(t, inner.choice("ua"), inner.choice(alphabet)) for t in range(inner.randint(1, longest))]
        rows += [(c, *t) for t in turns if c % 9 or t[0] % 2]
    return rows


EDGES = [(None, 0, "u", "lost"), (1, None, "u", "first  of\tall"), (1, 0, None, None), (1, 0, "", ""), (2, 5, "u", "x y z"), (2, 5, "a", "tie"), (21, 0, "u", "short"), (40, 0, "u", "word " * 200_000), (41, 0, "u", "word " * 200_000), (41, 1, "u", ""), (7, 1, "s", "a"), (7, 1, "s", "a")]


@pytest.mark.parametrize("sizes", [{}, {"local_turns": 4}, {"local_turns": 6, "first_segment": 2, "last_segment": 3}, {"local_turns": 1, "first_segment": 1, "last_segment": 1}])
def test_edges(spark, sizes):
    check(spark, EDGES + [(c, t, "u", "same start" if t < 6 else str(c)) for c in (100, 103, 104, 109) for t in range(8)], **sizes)


@pytest.mark.parametrize(("seed", "sizes"), [(1, {"local_turns": 30}), (2, {"local_turns": 20, "first_segment": 3, "last_segment": 4}), (3, {"local_turns": 12, "first_segment": 2, "last_segment": 40})])
def test_shared_starts(spark, seed, sizes):
    check(spark, conversations(seed, 60, ["a b", "c"], 9), **sizes)


def test_copies_and_hot_conversation(spark):
    """A group of copies, and one conversation that holds a third of the turns."""
    rows = [(c, t, "u", f"{t} w") for c in range(1, 1201, 2) for t in range(2)] + [(5000, t, "u", f"long {t % 7}") for t in range(300)]
    rows += [(5001, t, "u", f"long {t % 7}") for t in range(150)]
    check(spark, rows, local_turns=64, first_segment=16, last_segment=32)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()]
    got = [tuple(r) for r in queries.QUERIES["op11_radix_conversation_trie"](spark, SMALL).collect()]
    key = lambda r: (r[1], r[0], repr(r))
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


def test_empty(spark):
    assert trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []
