"""The source divergence audit against a direct count with exact arithmetic."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa

from captureq.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(rows, least, top):
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        docs[lang].update(set(terms(text)))
        count[lang, source].update(terms(text))
    kept = {lang: {t for t, n in c.items() if n >= least} for lang, c in docs.items()}
    f = lambda p, q: (p - q) ** 2 // (p + q)

    def shares(lang, c):
        total = sum(n for t, n in c.items() if t in kept[lang])
        return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept[lang])) for t in kept[lang]}

    p = {g: shares(g[0], count[g]) for g in groups}
    q = {lang: shares(lang, sum((count[g] for g in groups if g[0] == lang), Counter())) for lang in docs}
    for lang, source in groups:
        mine = p[lang, source]
        pair = [(-sum(f(mine[t], p[lang, o][t]) for t in mine), o.encode(), o) for la, o in groups if la == lang and o != source]
        term = [(-f(x, q[lang][t]), t.encode(), t) for t, x in mine.items() if count[lang, source][t] and x > q[lang][t]]
        for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
            yield from ((lang, source, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found))


def same(spark, rows, least=3, top=4, **bounds):
    df = spark.createDataFrame([(*r, 1, "t", "s") for r in rows], "text string, lang string, source string, n int, term string, shard string")
    got = sorted(repr(tuple(r)) for r in divergence.divergence(df, least, top, **bounds).collect())
    assert got == sorted(map(repr, brute(rows, least, top)))
    return len(got)


def mixed():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aBcé日") for _ in range(rng.randint(1, 3)))
    rows = [("".join(word() + rng.choice([" ", "  ", "-", "\x7f", "\n", "9"]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None, "fr"]), rng.choice(["s1", "s2", "s3", None])) for _ in range(120)]
    return [*rows, *rows[:7], (None, "en", "s9"), ("", "en", "s8"), ("12 - 3", "es", "s1"), ("alone", "es", "s2"), (None, None, None), ("ab " * 60_000, "de", "s1")]


def test_audit_equals_brute_force(spark):
    assert same(spark, mixed()) > 60


def test_vocabulary_in_many_shards(spark):
    """Shards of a few terms: parts of one language, and several languages together."""
    df = spark.createDataFrame([(t, lang, s) for t, lang, s in mixed()], "text string, lang string, source string")
    kept = divergence.shards(divergence.kept_terms(df, 3), most_terms=16, most_bytes=1 << 20).collect()
    assert len({r.shard for r in kept}) > 4 and len({r.id for r in kept}) == len(kept)
    assert same(spark, mixed(), most_terms=16) == same(spark, mixed(), most_bytes=300)


def test_languages_share_shards_without_being_cut(spark):
    """Languages that fit into a shard together are scanned once; shards are full but for an eighth, and no fuller."""
    vocabulary = lambda lang, n: [(lang, f"t{k}", 3) for k in range(n)]
    dealt = lambda rows, most: divergence.shards(spark.createDataFrame(rows, "lang string, term string, docs long"), most_terms=most).collect()
    assert {r.shard for r in dealt(vocabulary("de", 40) + vocabulary("en", 98), 160)} == {0}
    many = Counter(r.shard for r in dealt(vocabulary("de", 400) + vocabulary("en", 3600), 1000))
    assert len(many) == 5 and sum(many.values()) == 4000 and max(many.values()) < 1100


def test_term_docs_counts_documents(spark):
    """Repeats in a document count once, terms end where documents do, and batches of no or one term pass."""
    rows = [("en", "b a B a"), ("en", "a"), ("de", "a"), ("en", ""), ("en", "1"), ("en", "a b"), ("de", "é-É")]
    batch = pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "text": [r[1] for r in rows]})
    got = Counter()
    for b in divergence._term_docs([batch, batch.slice(3, 2), batch.slice(1, 1)]):
        for x in b.to_pylist():
            got[x["lang"], x["term"]] += x["n"]
    assert got == {("en", "a"): 4, ("en", "b"): 2, ("de", "a"): 1, ("de", "é"): 1, ("de", "É"): 1}


def test_small_tables(spark):
    assert same(spark, []) == 0
    assert same(spark, [(None, None, None)]) == 0
    assert same(spark, [("one two", "en", "a"), ("two", "en", "b"), ("x", "de", "a")]) == 2  # no kept term: pairs of value 0
    assert same(spark, [("Tie tie TIE", "en", s) for s in "abc"] * 2 + [("other", "en", "d")] * 3, least=1) > 12


def test_neighbours_share_their_delimiter():
    sink = pa.BufferOutputStream()
    table = pa.table({"place": [0, 1, 2], "lang": ["en"] * 3, "term": ["a", "ab", "é"]})
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    found = divergence.automata("test", sink.getvalue().to_pybytes())["en"]
    ids, counts = divergence.occurrences(found, "A a a,ab É\x00é abc xa a".encode())
    assert dict(zip(ids.tolist(), counts.tolist())) == {0: 4, 1: 1, 2: 1}  # only A-Z is lower-cased


def test_pairs_in_small_steps(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PAIRS", 8)
    lists = pa.array([[{"gid": g, "p": 5 * g + k + 1, "p0": g + 1} for g in range(k % 5)] for k in range(40)], pa.list_(pa.struct([("gid", pa.int64()), ("p", pa.int64()), ("p0", pa.int64())])))
    got = Counter()
    for b in divergence._met([pa.RecordBatch.from_arrays([lists], ["l"])]):
        for x in b.to_pylist():
            got[x["a"], x["b"]] += x["value"]
    f = lambda p, q: (p - q) ** 2 // (p + q)
    want = Counter()
    for one in lists.to_pylist():
        for i, x in enumerate(one):
            for y in one[i + 1 :]:
                want[x["gid"], y["gid"]] += f(x["p"], y["p"]) - f(x["p"], y["p0"]) - f(x["p0"], y["p"]) + f(x["p0"], y["p0"])
    assert got == want
