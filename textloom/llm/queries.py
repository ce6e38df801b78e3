"""The registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, odd_sketches, packing, pitman_yor, quality, secrets, simhash, time_parts, token_counts, topk, urls, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": urls.op1_url_filter,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_packing": packing.op3_packing,
    "op4_language_model": pitman_yor.op4_language_model,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_quality": quality.op6_quality,
    "op7_revisits": warc.op7_revisits,
    "op8_exact_topk": topk.op8_exact_topk,
    "op9_simhash": simhash.op9_simhash,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_whitening": whitening.op11_whitening,
    "op12_odd_sketches": odd_sketches.op12_odd_sketches,
    "op13_time_parts": time_parts.op13_time_parts,
}

ORACLE_SQL: dict[str, str] = {
    "op7_revisits": warc.OP7_SQL,
    "op8_exact_topk": topk.OP8_SQL,
}
