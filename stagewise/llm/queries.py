"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from stagewise.llm import mixing, quality_rules
from stagewise.llm.html_text import op10_html_text
from stagewise.llm.mixing import op8_mixing
from stagewise.llm.neighbours import op2_nearest
from stagewise.llm.packing import op7_packing
from stagewise.llm.quality_net import op6_quality_net
from stagewise.llm.quality_rules import op9_quality_rules
from stagewise.llm.secret_scan import op3_secret_scan
from stagewise.llm.simhash import op5_simhash
from stagewise.llm.substring_dedup import op1_substring_dedup
from stagewise.llm.suffix_dedup import op4_suffix_dedup

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_nearest": op2_nearest,
    "op3_secret_scan": op3_secret_scan,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_simhash": op5_simhash,
    "op6_quality_net": op6_quality_net,
    "op7_packing": op7_packing,
    "op8_mixing": op8_mixing,
    "op9_quality_rules": op9_quality_rules,
    "op10_html_text": op10_html_text,
}

ORACLE_SQL: dict[str, str] = {
    "op8_mixing": mixing.ORACLE,
    "op9_quality_rules": quality_rules.ORACLE,
}
