"""The thin query of each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codes import code_query
from .fingerprint import fingerprint_query
from .forest import nearest
from .licenses import license_query
from .minhash import near_duplicates
from .mixing import mix_sources
from .packing import pack_documents
from .pieces import encode_documents
from .pii import personal_data
from .reputation import judge_urls
from .shared import table
from .spelling import spelling_variants
from .suffixes import repeated_passages
from .toxicity import toxicity_query

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the document of the same id: bad if of low quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    bad = F.greatest(1 - F.col("quality"), F.col("toxic"))
    out = judge_urls(table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))
    return out.withColumns({c: F.round(c, 6) for c in ("bad_rate", "bad_rate_low")})


def op2_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op3_semicrf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op4_forest_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op5_minmax_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_exact_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_query(table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sentencepiece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op10_sparse_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_query(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_query(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {
        "op1_url_reputation": op1_url_reputation,
        "op2_bestfit_packing": op2_bestfit_packing,
        "op3_semicrf_pii": op3_semicrf_pii,
        "op4_forest_ann": op4_forest_ann,
        "op5_minmax_neardup": op5_minmax_neardup,
        "op6_toxicity_grammar": op6_toxicity_grammar,
        "op7_exact_fingerprint": op7_exact_fingerprint,
        "op8_mix_sources": op8_mix_sources,
        "op9_sentencepiece_lattice": op9_sentencepiece_lattice,
        "op10_sparse_suffix_repeats": op10_sparse_suffix_repeats,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_license_rules": op12_license_rules,
        "op13_vector_codes": op13_vector_codes,
    }
