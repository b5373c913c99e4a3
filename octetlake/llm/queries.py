"""The numbered queries, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from octetlake.llm import decontaminate, embedding_dedup, langid, license_scan, mixing, quality, sharding, simhash, toxicity, url_filter
from octetlake.llm.common import table


def op1_decontaminate(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))



def op2_toxicity(spark, sf_dir):
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_embedding_dedup(spark, sf_dir):
    return embedding_dedup.report(table(spark, sf_dir, "embeddings"))


def op4_mixing(spark, sf_dir):
    return mixing.report(table(spark, sf_dir, "documents"))


def op5_license_scan(spark, sf_dir):
    return license_scan.report(table(spark, sf_dir, "documents"))


def op6_simhash(spark, sf_dir):
    return simhash.report(table(spark, sf_dir, "documents"))


def op7_quality(spark, sf_dir):
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_url_filter(spark, sf_dir):
    return url_filter.report(table(spark, sf_dir, "pages"))


def op9_langid(spark, sf_dir):
    return langid.report(table(spark, sf_dir, "documents"))


def op10_sharding(spark, sf_dir):
    return sharding.report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_toxicity, op3_embedding_dedup, op4_mixing, op5_license_scan, op6_simhash, op7_quality, op8_url_filter, op9_langid, op10_sharding)}
ORACLES = {"op1_decontaminate": decontaminate.SQL, "op8_url_filter": url_filter.SQL}
