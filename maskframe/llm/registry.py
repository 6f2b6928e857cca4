"""Queries of this subpackage for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from maskframe.llm.bpe_codec import op8_bpe_codec
from maskframe.llm.decontaminate import op4_benchmark_decontamination
from maskframe.llm.infill import OP11_SQL, op11_fill_in_middle
from maskframe.llm.language import op5_language_id
from maskframe.llm.licenses import op6_license_scans
from maskframe.llm.near_dedup import OP12_SQL, op12_minhash_near_dedup
from maskframe.llm.near_join import OP1_SQL, op1_ngram_jaccard_join
from maskframe.llm.quality import OP7_SQL, op7_quality_rules
from maskframe.llm.resample import OP13_SQL, op13_importance_resampling
from maskframe.llm.secrets import op3_secret_scans
from maskframe.llm.sharding import op10_sharding
from maskframe.llm.token_counts import op2_token_counts
from maskframe.llm.url_filters import OP9_SQL, op9_url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_token_counts": op2_token_counts,
        "op3_secret_scans": op3_secret_scans,
        "op4_benchmark_decontamination": op4_benchmark_decontamination,
        "op5_language_id": op5_language_id,
        "op6_license_scans": op6_license_scans,
        "op7_quality_rules": op7_quality_rules,
        "op8_bpe_codec": op8_bpe_codec,
        "op9_url_filters": op9_url_filters,
        "op10_sharding": op10_sharding,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_minhash_near_dedup": op12_minhash_near_dedup,
        "op13_importance_resampling": op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": OP1_SQL,
        "op7_quality_rules": OP7_SQL,
        "op9_url_filters": OP9_SQL,
        "op11_fill_in_middle": OP11_SQL,
        "op12_minhash_near_dedup": OP12_SQL,
        "op13_importance_resampling": OP13_SQL,
    }
