"""The numbered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from prismview.llm import best_fit_packing, chat_repair, decontamination, fill_in_middle, quality_classifier, quality_rules, secret_scans, sentence_pieces, simhash_dedup, spelling_variants, substring_dedup, url_filters, warc

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_simhash_dedup": simhash_dedup.op2_simhash_dedup,
    "op3_url_filters": url_filters.op3_url_filters,
    "op4_warc": warc.op4_warc,
    "op5_secret_scans": secret_scans.op5_secret_scans,
    "op6_quality_classifier": quality_classifier.op6_quality_classifier,
    "op7_chat_repair": chat_repair.op7_chat_repair,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_best_fit_packing": best_fit_packing.op10_best_fit_packing,
    "op11_sentence_pieces": sentence_pieces.op11_sentence_pieces,
    "op12_spelling_variants": spelling_variants.op12_spelling_variants,
    "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
}
ORACLE_SQL = {
    "op3_url_filters": url_filters.SQL,
    "op4_warc": warc.SQL,
    "op5_secret_scans": secret_scans.SQL,
    "op9_quality_rules": quality_rules.SQL,
    "op12_spelling_variants": spelling_variants.SQL,
    "op13_fill_in_middle": fill_in_middle.SQL,
}

