"""The dealt queries with their production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import (
    bpe, chosen_path, digests, epsilon_grid, l2ap, langid, maxent, mixing, oracles, order_minhash, quality, shards, warc, whitening,
)
from .base import query, remainder, table

# The rules that pages are judged by, and their verdicts.
URL_RULES = [
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
]


@query("op1_pareto_mix", oracles.MIX)
def op1(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies"
    )


@query("op2_maxent_lm")
def op2(spark, sf_dir):
    return maxent.score(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 7) == 2)


@query("op3_chosen_path", oracles.SHINGLES)
def op3(spark, sf_dir):
    return chosen_path.join(table(spark, sf_dir, "documents"), k=4, percent=80)


@query("op4_epsilon_grid", oracles.VECTORS)
def op4(spark, sf_dir):
    return epsilon_grid.join(table(spark, sf_dir, "embeddings"), cosine=0.98)


@query("op5_word_backoff")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder(F.col("doc_id"), 5) == 0)
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.predicted(docs, model, keep=["doc_id", "held_out"])


@query("op6_order_minhash")
def op6(spark, sf_dir):
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"))


@query("op7_dawg_bpe")
def op7(spark, sf_dir):
    return bpe.encode(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False
    )


@query("op8_weak_label_quality")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs))


@query("op9_digest_urls", oracles.URLS)
def op9(spark, sf_dir):
    return digests.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query("op10_jump_shards")
def op10(spark, sf_dir):
    return shards.shard_documents(table(spark, sf_dir, "documents"), 16).withColumn("law", F.lit("key"))


@query("op11_zip_warc", oracles.WARC)
def op11(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"), least_bytes=0)


@query("op13_whitening")
def op13(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=32, scale=64, shift=1_000_000)


@query("op12_l2ap_negatives", oracles.NEGATIVES)
def op12(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return l2ap.mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)
