"""The corpus pipeline: quality, language, near duplicates, repeated passages, packing.

Rows of any column set pass; doc_id, text and (to learn from) lang are read by name, n_chars follows a changed text where
it is there. All other columns are carried under names of their place, so that no column of an operator meets them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captureq.llm import langid, quality, repeats, shingles
from captureq.llm import queries as q
from captureq.llm.common import bounded_batches, written

#: Documents whose probability of quality 1 is under this are rejected: somewhat under a half, to keep clean ones.
REJECT_BELOW = 0.4
#: A repeated passage of more than this many words is cut. It has 101 bytes at least (words and the spaces between), so
#: strings of 100 bytes find all of them; width divides the length.
PASSAGE_WORDS, PASSAGE_BYTES, PASSAGE_CORE, PASSAGE_WIDTH = 50, 100, 40, 50


#: Columns that stages read or change.
READ = ("doc_id", "text", "lang", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def carried(stage: Stage) -> Stage:
    """A stage over docs whose other columns have names of their place, and get their own back."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in READ else f"carried{k}" for k, c in enumerate(docs.columns)]
        out = stage(spark, docs.toDF(*names), sf_dir)
        return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])

    return run


@carried
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Null and empty texts are scored as empty texts."""
    bounded_batches(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, carry=True).filter(F.col("score") >= REJECT_BELOW).select(*docs.columns)


@carried
def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language: a text that is null, has no letter or is under the model's bound goes."""
    out = langid.predict(docs, langid.train(docs), carry=True)
    return out.filter(~F.col("rejected")).select(*docs.columns)


@carried
def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingle sets of similarity 0.8, linked) the document of smallest id,
    of equal ids the text of least hash, once; a row is known by id and text. Rows without an id stay: they have no name by which one could be chosen."""
    groups = shingles.near_copies(docs).filter("doc_id is not null")
    keep = groups.groupBy("component").agg(F.min(F.struct("doc_id", "t1", "t2")).alias("s")).select("s.doc_id", F.col("s.t1").alias("_t1"), F.col("s.t2").alias("_t2"))
    t1, t2 = shingles.text_hashes()
    named = docs.withColumn("_t1", t1).withColumn("_t2", t2)
    kept = named.join(keep, ["doc_id", "_t1", "_t2"], "left_semi").dropDuplicates(["doc_id", "_t1", "_t2"]).select(*docs.columns)
    return kept.unionByName(docs.filter("doc_id is null"))


@carried
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the byte runs that repeat and hold over 50 words, or 400 bytes in any number of words;
    characters that a cut leaves incomplete go too."""
    out = repeats.remove_repeats(docs, length=PASSAGE_BYTES, core=PASSAGE_CORE, width=PASSAGE_WIDTH, words=PASSAGE_WORDS, enough=400)
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(repeats.valid_text(F.col("kept")))
    new = {"text": text} | ({"n_chars": F.when(F.size("spans") == 0, F.col("n_chars")).otherwise(F.length(text).cast("long"))} if "n_chars" in docs.columns else {})
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids; executors still hold what the stages before have left, so
    the encoder's cache is smaller here."""
    return q.packed(docs, cache_entries=150_000)


#: (name, function of (spark, docs, sf_dir)); each works on all that the one before it kept.
STAGES = [("quality classifier", keep_quality), ("language ID", keep_language), ("SimHash near-dedup", keep_distinct), ("suffix-array dedup", cut_repeats), ("best-fit packing", pack)]

#: Trained models and tokenisers have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in turn to the documents table."""
    bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
