"""Registered queries of the training-data operators: thin digests of what
the operators return, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import filter_audit, fingerprints, lang_id, lm_score, mixing, order_packing, packing, pii, quality, simhash_dedup, token_align, token_count, url_filter
from quarry.llm.common import prepare, read

TOKEN_LIMIT = 4096
MIX_WEIGHTS = [5, 2, 1]
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
             ("allow", "org", "/fr/")]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file; the operators take paths as parameters."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def register(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        return fn
    return deco


@register("op1_simhash_near_dedup")
def op1(spark, sf):
    found = simhash_dedup.near_duplicates(read(spark, sf, "documents"), shingle=3, max_bits=2)
    return found.select("doc_id", simhash_dedup.hex_fingerprint().alias("fingerprint"), "component_id")


@register("op2_document_fingerprints")
def op2(spark, sf):
    return fingerprints.document_fingerprints(read(spark, sf, "documents"))


@register("op3_lm_score")
def op3(spark, sf):
    return lm_score.score(read(spark, sf, "documents"), held_out=lang_id.remainder(5) == 1)


@register("op4_mix_sources")
def op4(spark, sf):
    mixed = mixing.mix(read(spark, sf, "documents"), weights=MIX_WEIGHTS, factor=1.5, max_epochs=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "whole", "part")


@register("op5_url_filter")
def op5(spark, sf):
    return url_filter.judge(read(spark, sf, "pages"), URL_RULES)


@register("op6_language_id")
def op6(spark, sf):
    docs = read(spark, sf, "documents")
    held = lang_id.remainder(3) == 1
    model = lang_id.fit(docs.where(~held))
    return (lang_id.predict(docs, model, ["doc_id"])
            .select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score"))


@register("op7_pack_sequences")
def op7(spark, sf):
    return packing.pack(read(spark, sf, "documents"), tokenizer_path("byte_bpe_50k.json"), 2048, end_id=0)


@register("op8_quality_rules")
def op8(spark, sf):
    return quality.judge(read(spark, sf, "documents"))


@register("op9_personal_data")
def op9(spark, sf):
    found = pii.find(read(spark, sf, "documents"))
    counts = [pii.count_kind("base", k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.span_text("base"), 256).alias("base_sha256"),
                        pii.span_text("spans").alias("spans"))


@register("op10_token_counts")
def op10(spark, sf):
    counts = token_count.token_counts(read(spark, sf, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@register("op11_token_alignment")
def op11(spark, sf):
    return token_align.align(read(spark, sf, "documents"), tokenizer_path("byte_bpe_50k.json"),
                             tokenizer_path("piece_bpe_32k.model"))


@register("op12_order_packing")
def op12(spark, sf):
    return order_packing.pack(read(spark, sf, "documents"), tokenizer_path("byte_bpe_50k.json"), 1024, end_id=0)


@register("op13_filter_audit")
def op13(spark, sf):
    filters = filter_audit.contract_filters(F.coalesce("text", F.lit("")))
    found = filter_audit.audit(read(spark, sf, "documents"), read(spark, sf, "labels"), filters, duplicate="E",
                               part=F.coalesce("lang", F.lit("")))
    return found.drop("filter")
