"""The queries of this package and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from siteloom.llm import bpe, chat, decontam, fim, htmltext, jaccard, langid, negatives, quality, subword, toxicity, urlfilter, warc

QUERIES = {
    "op1_chat_formatting": chat.query,
    "op2_byte_bpe": bpe.query,
    "op3_url_filters": urlfilter.query,
    "op4_language_id": langid.query,
    "op5_decontamination": decontam.query,
    "op6_quality_rules": quality.query,
    "op7_warc_revisits": warc.query,
    "op8_html_text": htmltext.query,
    "op9_toxicity": toxicity.query,
    "op10_jaccard_join": jaccard.query,
    "op11_fill_in_middle": fim.query,
    "op12_hard_negatives": negatives.query,
    "op13_quality_classifier": subword.query,
}
ORACLES = {
    "op1_chat_formatting": chat.ORACLE,
    "op3_url_filters": urlfilter.ORACLE,
    "op5_decontamination": decontam.ORACLE,
    "op6_quality_rules": quality.ORACLE,
    "op7_warc_revisits": warc.ORACLE,
    "op11_fill_in_middle": fim.ORACLE,
    "op12_hard_negatives": negatives.ORACLE,
}
