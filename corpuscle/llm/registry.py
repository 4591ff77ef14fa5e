"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuscle.llm import alignment, bpe, fingerprint, language_id, license_scan, media, mixing, quality, simhash, suffix_dedup, toxicity, vector_codes, warc

QUERIES = [
    language_id.op1_language_id,
    toxicity.op2_toxicity,
    media.op3_media,
    fingerprint.op4_fingerprint,
    mixing.op5_mixing,
    warc.op6_warc,
    suffix_dedup.op7_suffix_dedup,
    bpe.op8_bpe,
    license_scan.op9_licenses,
    simhash.op10_simhash,
    quality.op11_quality,
    vector_codes.op12_vector_codes,
    alignment.op13_alignment,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": warc.OP6_SQL, "op12_vector_codes": vector_codes.OP12_SQL}
