"""The queries of this package, as ``__spark_entry__.py`` adds them."""

from __future__ import annotations

from . import decontaminate, lines, quality, urls
from .decontaminate import op5_decontamination
from .extract import op3_html_extraction
from .licences import op6_licence_scan
from .lines import op10_line_dedup
from .packing import op2_packing
from .quality import op1_quality_rules
from .simhash import op8_simhash
from .tokens import op7_token_counts
from .toxicity import op9_toxicity
from .urls import op4_url_filters

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_packing": op2_packing,
    "op3_html_extraction": op3_html_extraction,
    "op4_url_filters": op4_url_filters,
    "op5_decontamination": op5_decontamination,
    "op6_licence_scan": op6_licence_scan,
    "op7_token_counts": op7_token_counts,
    "op8_simhash": op8_simhash,
    "op9_toxicity": op9_toxicity,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality.ORACLE_SQL,
    "op4_url_filters": urls.ORACLE_SQL,
    "op5_decontamination": decontaminate.ORACLE_SQL,
    "op10_line_dedup": lines.ORACLE_SQL,
}
