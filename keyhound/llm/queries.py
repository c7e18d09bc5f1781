"""The queries of this subpackage, and SQL that gives the same rows."""

from __future__ import annotations

from . import chat, decontaminate, line_dedup, url_filter
from .imatch import op9_imatch_fingerprints
from .packing import op3_sum_of_squares_packing
from .quality import op5_quality_classifier
from .simhash import op7_simhash_near_dedup
from .token_files import op2_simple8b_token_files
from .wrappers import op6_wrapper_extraction

QUERIES = {
    f.__name__: f
    for f in (
        decontaminate.op1_benchmark_decontamination,
        op2_simple8b_token_files,
        op3_sum_of_squares_packing,
        line_dedup.op4_line_dedup,
        op5_quality_classifier,
        op6_wrapper_extraction,
        op7_simhash_near_dedup,
        url_filter.op8_url_bloom_cascade,
        op9_imatch_fingerprints,
        chat.op10_chat_formatting,
    )
}
ORACLE_SQL = {
    "op1_benchmark_decontamination": decontaminate.SQL,
    "op4_line_dedup": line_dedup.SQL,
    "op8_url_bloom_cascade": url_filter.SQL,
    "op10_chat_formatting": chat.SQL,
}
