"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import exact_dedup, fagin, mixing, near_dedup, packing, pii, quality, token_counts, url_filter, warc
from .scratch import table


def op1_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_fagin_top_k(spark, sf_dir):
    return fagin.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_pii(spark, sf_dir):
    return pii.sanitise(table(spark, sf_dir, "documents")).drop("sanitised")


def op6_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_near_dedup(spark, sf_dir):
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op10_url_filter(spark, sf_dir):
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_exact_dedup, op3_mixing, op4_fagin_top_k, op5_pii, op6_quality, op7_packing, op8_warc, op9_near_dedup, op10_url_filter)}
ORACLES = {"op2_exact_dedup": exact_dedup.ORACLE, "op4_fagin_top_k": fagin.ORACLE, "op8_warc": warc.ORACLE, "op9_near_dedup": near_dedup.ORACLE, "op10_url_filter": url_filter.oracle()}
