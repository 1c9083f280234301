"""Quality rules against brute force: words, lines, repeats of any length, texts of a slice side by side."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from captureq.llm import rules

WORD = "[^\x20\x09-\x0d]+"


def brute(t, least):
    w = re.findall(WORD, t or "")
    n = len(w)
    lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
    shared = np.zeros((n + 1, n + 1), int)
    for i in range(n - 1, -1, -1):
        for j in range(n - 1, -1, -1):
            if i != j and w[i] == w[j]:
                shared[i, j] = 1 + shared[i + 1, j + 1]
    best = [int(shared[i].max()) for i in range(n)]
    covered = {k for i, b in enumerate(best) if b >= least for k in range(i, i + b)}
    found = set()
    for size in range(least, n + 1):
        at = defaultdict(list)
        for i in range(n - size + 1):
            at[tuple(w[i : i + size])].append(i)
        for s, o in at.items():
            if len(o) > 1 and len({w[i - 1] if i else i - 1 for i in o}) > 1 and len({w[i + size] if i + size < n else -1 for i in o}) > 1:
                found.add(s)
    return {
        "n_words": n, "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t or "")), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "repeat_chars": sum(len(w[k]) for k in covered), "longest_repeat": max([b for b in best if b >= least], default=0), "n_repeats": len(found),
    }


def texts(rng):
    for _ in range(rng.randint(0, 6)):
        letters = rng.choice(["a", "ab", "abc", "aé日"])
        yield "".join(rng.choice(letters) + rng.choice([" ", " ", "\n", "", "\x0b", "#"]) for _ in range(rng.randint(0, 60)))
    yield from rng.choice([[], ["", "\n", "\n\n a \n a"], [" x"], ["x", "x"]])


@pytest.mark.parametrize("least", [1, 2, 3, 5, 8])
def test_measures_equal_brute_force(least):
    for seed in range(40):
        some = list(texts(random.Random(seed)))
        raw = [t.encode() for t in some]
        got = rules.measures(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), least)
        assert [{c: int(got[c][k]) for c in rules.COUNTS} for k in range(len(some))] == [brute(t, least) for t in some]


def test_spans_are_the_repeated_words():
    text = "one two three four x one two three four y six"
    got = rules.measures(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), 3)
    assert got["spans"] == [[(0, 4), (5, 9)]] and got["n_repeats"].tolist() == [1] and got["longest_repeat"].tolist() == [4]


def test_maximal_repeats_name_their_interval():
    codes = np.array([1, 2, 3, 9, 1, 2, 3, 8, 2, 3])
    ends = np.full(10, 10)
    sa, levels = rules.suffix_array(codes, np.zeros(10, int), ends)
    assert [codes[i:].tolist() for i in sa] == sorted(codes[i:].tolist() for i in range(10))
    slots, lcp = rules.common_prefixes(sa, levels, ends, 2)
    before = np.concatenate([[-1], codes[:-1]])
    assert sorted((words, n) for _, n, words in rules.maximal_repeats(sa, slots, lcp, before)) == [(2, 3), (3, 2)]


def test_rules_on_a_table(spark):
    rng = random.Random(8)
    clean = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400))
    passage = " ".join(clean.split()[:70])
    long_text = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(120_000))
    rows = [(1, None), (2, ""), (3, "few words"), (4, clean), (4, clean), (5, "spam and eggs\n" * 40), (6, clean + " " + passage), (7, clean + " " + " ".join(passage.split()[:40])), (None, clean), (8, long_text)]
    df = spark.createDataFrame([(i, t, 0, "k", "s") for i, t in rows], "doc_id long, text string, n_words int, kept string, spans string")
    got = {(r.doc_id, r.n_words): (r.base_failed, r.kept, r.n_dup_lines, r.longest_repeat) for r in rules.quality_rules(df).collect()}
    assert got == {
        (1, 0): (True, False, 0, 0), (2, 0): (True, False, 0, 0), (3, 2): (True, False, 0, 0), (4, 400): (False, True, 0, 0), (5, 120): (True, False, 39, 117), (6, 470): (False, False, 0, 70),
        (7, 440): (False, True, 0, 40), (None, 400): (False, True, 0, 0), (8, 120_000): (False, True, 0, 0),
    }
    assert rules.quality_rules(df).count() == len(rows) and rules.quality_rules(df.limit(0)).count() == 0
