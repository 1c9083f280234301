"""Source divergence audit: how the terms of each source of a language differ from those of the language and of the
other sources.

The first pass counts in how many documents of its language a term stands, and keeps the frequent ones. The second pass
counts their occurrences by automata over delimited text: one for each language of a shard of kept terms. Counts are
sparse postings (group, term); a group's probability of a term without occurrences is one number, so sums over all kept
terms come from the postings, from how many terms have each probability, and from the number of terms."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import frequent_join, raw_bytes, released, text_slices, written

#: Documents of its language that a kept term stands in; the unit of probability; ranks of the term part.
LEAST_DOCS, SCALE, TOP = 10, 1_000_000_000, 10
#: Kept terms of a shard, and their bytes: what one automaton table holds, and what is sent to every executor.
SHARD_TERMS, SHARD_BYTES = 250_000, 4 << 20
#: Parts of a shard that a language's terms are dealt into; a shard takes parts until it lacks one.
PARTS = 8
#: Counts that a task holds before it sums them, and pairs of postings that are worked out at once.
HELD, PAIRS = 1 << 20, 1 << 20

#: For each byte its form in a term: A-Z lower-cased, other letters and bytes of non-ASCII characters themselves, others a space.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def named(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values in order, by sorting: numpy's own unique goes by a hash table, which is slower by far here."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])[: len(values)]]


def _term_docs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, documents) of the slices of (lang, text) rows."""
    for batch in parts:
        for a, b, col in text_slices(batch, 1, 4 << 20):
            data, off = raw_bytes(col)
            data = np.frombuffer(data.tobytes().translate(_TERM), np.uint8)
            inside = data != 32
            # Borders between terms and the rest, in turn a term's begin and its stop.
            edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
            begin, stop = edge[::2], edge[1::2]
            cuts = off[1:-1]
            cuts = distinct(cuts[(cuts > 0) & (cuts < len(data))])
            cuts = cuts[inside[cuts] & inside[cuts - 1]]
            begin, stop = np.sort(np.concatenate([begin, cuts])), np.sort(np.concatenate([stop, cuts]))
            if not len(begin):
                continue
            joined = data[inside]
            at = np.concatenate([[0], np.cumsum(stop - begin)]).astype(np.int64)
            terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(at), pa.py_buffer(joined)]).dictionary_encode()
            langs = batch.column(0).slice(a, b - a).dictionary_encode()
            n = len(terms.dictionary)
            doc = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(begin, off)))
            seen = distinct(doc * n + terms.indices.to_numpy())
            lang = langs.indices.to_numpy().astype(np.int64)[seen // n]
            keys, counts = np.unique(lang * n + seen % n, return_counts=True)
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(keys // n)), terms.dictionary.take(pa.array(keys % n)).cast(pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=["lang", "term", "n"])


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, docs) of the terms in at least `least` documents of a language, counted over all documents."""
    counted = named(docs).select("lang", "text").mapInArrow(released(_term_docs), "lang string, term string, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("docs")).filter(F.col("docs") >= least)


def shards(kept: DataFrame, most_terms: int = SHARD_TERMS, most_bytes: int = SHARD_BYTES) -> DataFrame:
    """(shard, id, lang, term) of all kept terms; an id is a shard's number in its upper half and a place in the lower.

    A language's terms are dealt by hash into parts of an eighth of a shard's terms and bytes; parts fill shards in turn,
    seven eighths of each on average, so that few languages' texts are scanned for several shards. A term longer than a shard's bytes makes a shard so much larger."""
    kept = written(kept, "frequent-terms")
    size = F.octet_length("term") + 8
    need = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b"), F.count(F.lit(1)).alias("weight"))
    need = written(need.select("lang", F.ceil(F.greatest(PARTS * F.col("n") / most_terms, PARTS * F.col("b") / most_bytes)).cast("long").alias("parts"), "weight"), "languages")
    dealt = written(frequent_join(kept, need, ["lang"], "weight", "inner").select("lang", "term", F.pmod(F.xxhash64("term"), "parts").alias("deal")), "dealt")
    per = dealt.groupBy("lang", "deal").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b"))
    filled = F.greatest(PARTS * F.col("n") / most_terms, PARTS * F.col("b") / most_bytes)
    # One row for each eighth of a shard of the vocabulary: few, so they may be numbered in one task.
    so_far = F.coalesce(F.sum(filled).over(Window.orderBy("lang", "deal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    per = per.select("lang", "deal", F.floor(so_far / (PARTS - 1)).cast("long").alias("shard"), F.col("n").alias("weight"))
    placed = frequent_join(dealt, written(per, "shards"), ["lang", "deal"], "weight", "inner")
    place = F.row_number().over(Window.partitionBy("shard").orderBy("lang", "term")) - 1
    return placed.select("shard", (F.shiftleft("shard", 32) + place).alias("id"), "lang", "term")


class _Counter:
    """Sums of counts under (group, term) keys, kept small by adding up equal keys."""

    def __init__(self, base: int):
        self.base = base
        self._clear()

    def _clear(self) -> None:
        self.groups, self.keys, self.counts, self.held = {}, [], [], 0

    def add(self, group: tuple[str, str], ids: np.ndarray, counts: np.ndarray) -> None:
        at = self.groups.setdefault(group, len(self.groups))
        self.keys.append(ids | (at << 32))
        self.counts.append(counts)
        self.held += len(ids)

    def fold(self) -> None:
        if self.keys:
            key, value = np.concatenate(self.keys), np.concatenate(self.counts)
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
            self.keys, self.counts, self.held = [key[at]], [np.add.reduceat(value, at) if len(at) else value], len(at)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """What is held, (lang, source, id, n); nothing is held then."""
        self.fold()
        langs, sources = (pa.array([g[k] for g in self.groups], pa.string()) for k in (0, 1))
        key, value = (self.keys[0], self.counts[0]) if self.keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for a in range(0, len(key), 100_000):
            group = pa.array(key[a : a + 100_000] >> 32)
            yield pa.RecordBatch.from_arrays(
                [langs.take(group), sources.take(group), pa.array(self.base + (key[a : a + 100_000] & 0xFFFFFFFF)), pa.array(value[a : a + 100_000])], names=["lang", "source", "id", "n"]
            )
        self._clear()


#: The automata of the shard that this worker met last: (its name, automata by language).
_LAST: list = [None, None]


def automata(name: str, packed: bytes) -> dict[str, ahocorasick.Automaton]:
    """An automaton for each language over its terms between delimiters; a term's value is its place in the shard."""
    if _LAST[0] != name:
        _LAST[:] = None, None
        out: dict[str, ahocorasick.Automaton] = {}
        for batch in pa.ipc.open_stream(packed):
            for place, lang, term in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if lang not in out:
                    out[lang] = ahocorasick.Automaton(ahocorasick.STORE_INTS)
                out[lang].add_word(f" {term} ", place)
        for a in out.values():
            a.make_automaton()
        _LAST[:] = name, out
    return _LAST[1]


def occurrences(automaton: ahocorasick.Automaton, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(terms, counts) of one text: every delimited occurrence, neighbours sharing their delimiter."""
    found = np.fromiter((k for _, k in automaton.iter(f" {text.translate(_TERM).decode()} ")), np.int64)
    return np.unique(found, return_counts=True)


def _recount(name: str, shard: int, packed: Broadcast):
    @released
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang, held = automata(name, packed.value), _Counter(shard << 32)
        for batch in parts:
            for a, b, col in text_slices(batch, 2, 4 << 20):
                langs, sources = (batch.column(k).slice(a, b - a).to_pylist() for k in (0, 1))
                texts: dict[tuple[str, str], list[bytes]] = {}
                for lang, source, text in zip(langs, sources, col.cast(pa.binary()).to_pylist(), strict=True):
                    if lang in by_lang:
                        texts.setdefault((lang, source), []).append(text)
                # A language's groups one after the other, so that its automaton stays in the processor's cache.
                for group in sorted(texts):
                    held.add(group, *occurrences(by_lang[group[0]], b" ".join(texts[group])))
                if held.held > HELD:
                    held.fold()
                    if 2 * held.held > HELD:
                        yield from held.rows()
        yield from held.rows()

    return run


def counted(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, id, n) of the kept terms that occur in each group. kept: the written table of `shards`.

    The driver reads a shard, whose size is bounded, and sends it to the executors; the texts of its languages are
    scanned once for it, a language's texts once for each shard that holds some of its terms."""
    spark = docs.sparkSession
    spans = sorted((r.shard, sorted(r.langs)) for r in kept.groupBy("shard").agg(F.collect_set("lang").alias("langs")).collect())
    out = spark.createDataFrame([], "lang string, source string, id long, n long")
    for shard, langs in spans:
        table = kept.filter(F.col("shard") == shard).select((F.col("id") - (shard << 32)).alias("place"), "lang", "term").toArrow()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        packed = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
        out = out.unionByName(named(docs).filter(F.col("lang").isin(langs)).mapInArrow(_recount(f"{kept.scratch}-{shard}", shard, packed), "lang string, source string, id long, n long"))
    return out.groupBy("lang", "source", "id").agg(F.sum("n").alias("n"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column, vocabulary: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * vocabulary)) by long division in three steps of a thousand, exact in
    64 bits up to 9e15 occurrences; null where the vocabulary is empty."""
    whole = total + 2 * vocabulary
    quotient, rest = F.lit(0).cast("long"), count + F.lit(2).cast("long")
    for _ in range(3):
        quotient, rest = quotient * 1000 + _div(rest * 1000, whole), (rest * 1000) % whole
    return F.when(vocabulary > 0, 1 + quotient)


def gap(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _met(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, value) of posting lists (terms that groups a and b share): what such terms add to the sum over all terms,
    beyond what each posting adds by itself. Lists of one length are worked out together."""

    def f(p, q):
        return (p - q) ** 2 // (p + q)

    for batch in parts:
        lists = batch.column(0)
        flat = lists.flatten()
        gid, p, p0 = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        names, gid = np.unique(gid, return_inverse=True)
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.cumsum(lengths) - lengths
        keys, values, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

        def folded():
            key, value = np.concatenate(keys), np.concatenate(values)
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
            return key[at], np.add.reduceat(value, at) if len(at) else value

        for m in np.unique(lengths[lengths > 1]).tolist():
            every = begin[lengths == m]
            step = max(1, PAIRS // m)
            for a in range(0, len(every), step):
                at = every[a : a + step, None] + np.arange(m)
                g, x, x0 = gid[at], p[at], p0[at]
                for i in range(m - 1):
                    l, l0, r, r0 = x[:, i : i + 1], x0[:, i : i + 1], x[:, i + 1 :], x0[:, i + 1 :]
                    values.append((f(l, r) - f(l, r0) - f(l0, r) + f(l0, r0)).ravel())
                    keys.append((g[:, i : i + 1] * len(names) + g[:, i + 1 :]).ravel())
                    held += len(keys[-1])
                    if held > PAIRS:
                        key, value = folded()
                        keys, values, held = [key], [value], 0
        key, value = folded()
        if len(key):
            yield pa.RecordBatch.from_arrays([pa.array(names[key // len(names)]), pa.array(names[key % len(names)]), pa.array(value)], names=["a", "b", "value"])


def divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, **bounds: int) -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source) group of docs.

    Part pair: item is each other source of the language, value the gap of their probabilities summed over all kept terms
    (0 where the language keeps none). Part term: item is each kept term that is likelier in the group than in the
    language, of the `top` highest gaps. Ranks go by value, downward, then item by bytes.

    A null text, lang or source counts as empty, a group of such rows as any other; repeated rows count each. Groups
    without a term take part in the pairs. An empty table gives no rows; columns but those three are not read. Every pair
    of sources of a language is a row of the result, so its size is quadratic in a language's sources."""
    kept = written(shards(kept_terms(docs, least), **bounds), "kept-terms")
    counts = written(counted(docs, kept), "counts")
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("postings"))
    whole = counts.groupBy("lang").agg(F.sum("n").alias("all"))
    langs = written(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary")).join(whole, "lang", "left").select("lang", "vocabulary", F.coalesce("all", F.lit(0)).alias("all")), "languages")
    groups = named(docs).select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs.select("lang", "vocabulary"), "lang", "left").na.fill(0, ["total", "postings", "vocabulary"])
    groups = written(groups.withColumn("p0", share(F.lit(0), F.col("total"), F.col("vocabulary"))).withColumn("gid", F.monotonically_increasing_id()), "groups")
    postings = frequent_join(counts, groups, ["lang", "source"], "postings", "inner").withColumn("p", share(F.col("n"), F.col("total"), F.col("vocabulary")))
    postings = written(postings.select("gid", "lang", "source", "id", "n", "p", "p0"), "postings")

    # Terms that are likelier in a group than in its language.
    terms = frequent_join(kept.join(counts.groupBy("id").agg(F.sum("n").alias("n")), "id"), langs.withColumn("weight", F.col("vocabulary")), ["lang"], "weight", "inner")
    terms = terms.select("id", "term", share(F.col("n"), F.col("all"), F.col("vocabulary")).alias("q"))
    likely = postings.join(terms, "id").filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))

    # Sums over all kept terms: as if every term had no occurrence in both, then what postings change by themselves, then
    # what they change where both groups have one.
    of = lambda side: groups.select("lang", F.col("gid").alias(side), F.col("source").alias(f"{side}_source"), F.col("p0").alias(f"{side}_p0"), "vocabulary")
    pairs = of("a").join(of("b").drop("vocabulary"), "lang").filter("a <> b")
    nothing = gap(F.col("a_p0"), F.col("b_p0"))
    often = postings.groupBy(F.col("gid").alias("a"), "p").agg(F.count(F.lit(1)).alias("times"))
    alone = pairs.join(often, "a").groupBy("a", "b").agg(F.sum(F.col("times") * (gap(F.col("p"), F.col("b_p0")) - nothing)).alias("value"))
    lists = postings.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("gid", "p", "p0"))).alias("l")).filter(F.size("l") > 1).select("l")
    met = lists.mapInArrow(released(_met), "a long, b long, value long")
    turned = alone.unionByName(met).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "value").groupBy("a", "b").agg(F.sum("value").alias("changed"))
    both = turned.unionByName(turned.select(F.col("b").alias("a"), F.col("a").alias("b"), "changed"))
    value = F.coalesce(F.col("vocabulary") * nothing, F.lit(0)) + F.coalesce("changed", F.lit(0))
    apart = pairs.join(both, ["a", "b"], "left").select("lang", F.col("a_source").alias("source"), F.lit("pair").alias("part"), F.col("b_source").alias("item"), value.alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return apart.withColumn("rank", rank).unionByName(likely.withColumn("rank", rank).filter(F.col("rank") <= top))
