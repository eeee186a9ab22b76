"""The prefix trie against a nested-dictionary build, and its perfect hash."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from assay.llm import prefix_trie as trie

TURNS = "conv_id long, turn long, role string, text string, depth string"


def brute(rows):
    """The contract's tuples per node, by walking every prefix."""
    turns = defaultdict(list)
    for c, n, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            order = (n is not None, n or 0, role, text[: trie.TIE], hashlib.md5(text.encode()).hexdigest())
            turns[c].append((order, role, text))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        rebuilt[c] = own.get(base, [])[:h] + v[h:]
    members, ends = defaultdict(set), defaultdict(set)
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].add(c)
        ends[tuple(v)].add(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, own_members in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(own_members) - 1) * words
    return {
        (
            min(m), len(node), min(members[node[:-1]]) if node else None, len(m), children[node], leaves[node],
            saved[node], hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        )
        for node, m in members.items()
    }


def found(spark, rows, shard=trie.SHARD):
    df = spark.createDataFrame([(*r, "x") for r in rows], TURNS)
    out = trie.prefix_trie(trie.rebuilt_turns(trie.ordered_turns(df)), shard).collect()
    assert len({tuple(r) for r in out}) == len(out)
    return {tuple(r) for r in out}


def family(n, long):
    rng = np.random.default_rng(n)
    rows = []
    for c in range(n):
        size = long if c == 7 else int(rng.integers(1, 7))
        for t in range(size):
            text = "hello  there x" if t == 0 and c % 3 else f"say {rng.integers(0, 2)}\t{t}"
            rows.append((c, t, ("user", "assistant")[t % 2], text))
    return rows


@pytest.mark.parametrize("piece", [2, 5, 1024])
def test_equal_to_nested_prefixes(spark, monkeypatch, piece):
    """Short pieces, shards and id blocks: what lies in other pieces and shards is summed up."""
    monkeypatch.setattr(trie, "PIECE", piece)
    monkeypatch.setattr(trie, "ID_BLOCK", 9)
    rows = family(60, 41) + [(63 + i, t, "user", f"same {t}") for i in range(30) for t in range(5)]
    assert found(spark, rows, shard=25) == brute(rows)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(trie, "REPEAT", 3)
    rows = [
        (0, 0, "user", "a b"), (1, None, None, None), (1, 0, "user", "a b"), (1, 0, "user", "a b"),
        (5, 2, "user", "z" * 300 + "b"), (5, 2, "user", "z" * 300 + "a"), (5, 2, None, "y"),
        (None, 0, "user", "lost"), (-7, 0, "user", "a b"), (-7, 1, "assistant", ""), (43, 0, "user", "only"),
        (2**40, 0, "user", "long " * 60_000), *[(61, 4, "user", "again")] * 20,
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows[:0]) == set()
    assert found(spark, [(None, 0, "user", "x")]) == set()


def test_slots_are_minimal_perfect_and_verified():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2**63, (5000, 3)).astype(np.uint64), axis=0)
    table = trie.PerfectHash(keys)
    slots = table.slots(keys)
    assert sorted(slots) == list(range(len(keys)))
    assert (table.keys[slots] == keys).all()
    assert (table.slots(keys + np.uint64(1)) == -1).all()
    assert len(trie.PerfectHash(keys[:0]).slots(keys[:2])) == 2
    with pytest.raises(ValueError):
        trie.PerfectHash(np.repeat(keys[:1], 2, axis=0))
