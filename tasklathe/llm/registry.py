"""Driver queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bin_packing, jaccard_join, maxent_lm, maxscore, preference_pairs, quality_rules, secret_scan, source_mixing, toxicity
from .jaccard_join import jaccard_classes
from .piece_codec import encode_texts
from .sparkio import durable, table


def op1_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2n (chosen) and 2n + 1 (rejected) are pair n; masks are ``start:end`` spans, comma-joined."""
    turns = table(spark, sf_dir, "conversations").withColumn("pair_id", F.expr("conv_id div 2"))
    side = F.pmod(F.col("conv_id"), F.lit(2))
    pairs = preference_pairs.assemble(preference_pairs.masked_turns(turns.where(side == 0), turns.where(side == 1)))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias(c)
    return pairs.select("pair_id", "segment", "prompt", "chosen", "rejected", spans("chosen_mask"), spans("rejected_mask"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


def op3_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = maxscore.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return maxscore.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(toxicity.labelled_part(docs, table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = maxent_lm.score(table(spark, sf_dir, "documents"), ~maxent_lm.held_out(F.col("doc_id")))
    return scored.select("doc_id", maxent_lm.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("digest"))
    packed = bin_packing.assign(docs, F.col("size"), F.col("digest"), bins=16)
    return packed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    small = durable(docs.select("doc_id", "source", source_mixing.words(F.col("text")).alias("words")))
    mixed = source_mixing.mix(small, F.col("words"), source_mixing.quality(F.col("words")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [secret_scan.count(F.col("base_spans"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    digest = F.sha2(secret_scan.span_text(F.col("base_spans")).cast("binary"), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), secret_scan.span_text(F.col("spans")).alias("spans"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    coded = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), model_path)
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_preference_pairs": op1_preference_pairs,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_maxscore_topk": op3_maxscore_topk,
        "op4_toxicity": op4_toxicity,
        "op5_maxent_lm": op5_maxent_lm,
        "op6_quality_rules": op6_quality_rules,
        "op7_sharding": op7_sharding,
        "op8_source_mixing": op8_source_mixing,
        "op9_secret_scan": op9_secret_scan,
        "op10_sentencepiece": op10_sentencepiece,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_preference_pairs": preference_pairs.ORACLE,
        "op2_ngram_jaccard_join": jaccard_join.ORACLE,
        "op3_maxscore_topk": maxscore.ORACLE,
        "op6_quality_rules": quality_rules.ORACLE,
        "op8_source_mixing": source_mixing.ORACLE,
        "op9_secret_scan": secret_scan.ORACLE,
    }
