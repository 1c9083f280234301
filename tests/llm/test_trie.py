"""The conversation trie against brute force: ties, nulls, repeats, copies over several ranges, runs of a few rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from captureq.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, kind string, t int"


def built(rows, group=20, shared=4):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", hashlib.sha256((x or "").encode()).hexdigest(), x or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    heads = {c: zlib.crc32(str(c).encode()) % shared for c in own}
    return {c: own.get(c - int(abs(c) % group) * (1 if c > 0 else -1), [])[: heads[c]] + v[heads[c] :] for c, v in own.items()}


def brute(rows):
    convs = built(rows)
    node = defaultdict(list)
    for c, v in convs.items():
        for d in range(len(v) + 1):
            node[tuple(v[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in node:
        if k:
            kids[k[:-1]] += 1
    for k, m in node.items():
        w = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += w
    for k, m in node.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k))
        yield min(m), len(k), min(node[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()


def same(spark, rows, **options):
    df = spark.createDataFrame([(*r, "p", "k", 1) for r in rows], SCHEMA)
    got = sorted(repr(tuple(r)) for r in trie.conversation_trie(df, **options).collect())
    assert got == sorted(map(repr, brute(rows)))
    return len(got)


def mixed(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 400), 160):
        for t in range(rng.choice([1, 2, 3, 4, 5, 12])):
            text = rng.choice(["a b", "c", "", None, "d e\x85f g\t"]) if rng.random() < 0.5 else "same here"
            rows.append((c, rng.choice([None, t, t]), rng.choice(["user", None, "assistant"]) if rng.random() < 0.2 else "user", text))
    return [*rows, (None, 1, "user", "x"), *rows[:5]]


@pytest.mark.parametrize("options", [{}, {"run_bytes": 500, "ranges": 40}, {"run_bytes": 300, "ranges": 1}])
def test_trie_equals_brute_force(spark, options):
    assert same(spark, mixed(1), **options) > 300


def test_copies_over_ranges(spark, monkeypatch):
    """One conversation in very many copies, then the same with one turn more: their node lies in several ranges, and
    its ids are hashed from pieces."""
    monkeypatch.setattr(trie.range_nodes, "__defaults__", (64,))
    rows = [(c, t, "user", f"word {t}") for c in range(40, 1200) for t in range(4 if c % 3 else 5)]
    assert same(spark, rows, ranges=12, run_bytes=4000) == 6


def test_small_tables(spark):
    assert same(spark, []) == 0
    # Every conversation is rebuilt from a base that is absent: some lose all turns and are members of the root alone.
    assert same(spark, [(c, 0, "u", "x") for c in range(21, 29)]) == 2
    turnless = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4]
    assert same(spark, [(c, 0, "u", "x") for c in turnless]) == 1
    assert same(spark, [(20, None, None, None), (20, None, None, None), (21, 7, "", "")]) >= 2
    assert same(spark, [(1, t, "u", "w " * 50_000 if t == 3 else "w") for t in range(700)]) == 700 + 1 - zlib.crc32(b"1") % 4


def test_merge_carries_shared_turns():
    rng = random.Random(5)
    rows = sorted({(b"".join(rng.choice([b"a" * 16, b"b" * 16, b"c" * 16]) for _ in range(rng.randint(0, 5))), rng.randint(0, 50)) for _ in range(400)})
    runs = [[] for _ in range(7)]
    for x in rows:
        rng.choice(runs).append((*x, []))
    got = list(trie.merge([trie.with_lcp(r) for r in runs]))
    assert [x[:2] for _, x in got] == rows
    assert [n for n, _ in got] == [0, *(trie.shared_turns(a[0], b[0]) for a, b in zip(rows, rows[1:]))]
    assert not list(trie.merge([iter([]), iter([])]))


def test_role_and_text_do_not_run_together(spark):
    assert same(spark, [(20, 0, "ab", "c"), (40, 0, "a", "bc"), (60, 0, "", "abc"), (80, 0, "a\0b", "c")]) == 5
