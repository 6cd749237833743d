"""The queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, mixing, near_dedup, quality, suffix_dedup
from .bpe import op8_bpe
from .fingerprints import op7_fingerprints
from .language_id import op6_language_id
from .license_scan import op4_license_scan
from .token_records import op3_token_records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.op1_mixing,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_token_records": op3_token_records,
    "op4_license_scan": op4_license_scan,
    "op5_quality": quality.op5_quality,
    "op6_language_id": op6_language_id,
    "op7_fingerprints": op7_fingerprints,
    "op8_bpe": op8_bpe,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_near_dedup": near_dedup.op10_near_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": mixing.ORACLE,
    "op2_chat_format": chat_format.ORACLE,
    "op5_quality": quality.ORACLE,
    "op9_suffix_dedup": suffix_dedup.ORACLE,
    "op10_near_dedup": near_dedup.ORACLE,
}
