"""The registered queries: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, embed, langid, media, packing, quality, repeats, rules, simhash, trie, urlfilter, warc
from .common import bounded_batches, held_out, scratch_path
from .oracles import ORACLES  # noqa: F401  read by the driver entry


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, **options: int) -> DataFrame:
    """The digest columns of best-fit packing, one row per piece."""
    out = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), **options)
    return out.select("doc_id", "piece", "start", "length", F.crc32("tokens").alias("ids_crc32"), "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, then text: what is left, without characters that a cut has left incomplete."""
    out = repeats.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    n, left = (F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in ("text", "kept"))
    digest = F.sha2("kept", 256).alias("kept_sha256")
    return out.select("doc_id", n.alias("n_bytes"), (n - left).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), digest, repeats.valid_text(F.col("kept")).alias("text"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.bpe_encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.read_media(media.to_media(media.text_payload(_table(spark, sf_dir, "documents"))))
    n = F.octet_length("payload")
    return out.select(
        "doc_id", "n_bytes", n.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.col("payload").substr(n - 63, F.lit(64))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_vectors(_table(spark, sf_dir, "embeddings"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    out = warc.read_warc(spark, path)
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: Fixed values of the contract: verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(_table(spark, sf_dir, "conversations"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_embedding_neardup": op1_embedding_neardup,
    "op2_simhash": op2_simhash,
    "op3_packing": op3_packing,
    "op4_warc": op4_warc,
    "op5_quality": op5_quality,
    "op6_url_filter": op6_url_filter,
    "op7_langid": op7_langid,
    "op8_repeats": op8_repeats,
    "op9_bpe": op9_bpe,
    "op10_media": op10_media,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_quality_rules": op12_quality_rules,
    "op13_divergence": op13_divergence,
}
