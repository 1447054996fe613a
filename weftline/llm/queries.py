"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import chat, contamination, licenses, lines, lm, mixing, neardup, rules, urls, weaklabel

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_chat_format": chat.op2_chat_format,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_near_dedup": neardup.op4_near_dedup,
    "op5_quality_classifier": weaklabel.op5_quality_classifier,
    "op6_quality_rules": rules.op6_quality_rules,
    "op7_url_filter": urls.op7_url_filter,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_decontaminate": contamination.op9_decontaminate,
    "op10_lm_score": lm.op10_lm_score,
}

SQL = {
    "op1_license_scan": licenses.OP1_SQL,
    "op2_chat_format": chat.OP2_SQL,
    "op4_near_dedup": neardup.OP4_SQL,
    "op6_quality_rules": rules.OP6_SQL,
    "op7_url_filter": urls.OP7_SQL,
    "op8_mix_sources": mixing.OP8_SQL,
    "op9_decontaminate": contamination.OP9_SQL,
}
