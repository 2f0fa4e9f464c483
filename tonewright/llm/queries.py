"""Queries of the training-data operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from tonewright.llm import (
    ann_forest,
    bestfit_packing,
    byte_bpe,
    chat_format,
    filter_audit,
    html_tree,
    jpeg_dc,
    langid_ecoc,
    line_quality,
    line_runs,
    simhash_pivot,
    source_audit,
    toxicity_cnn,
)

QUERIES = {
    "op1_ann": ann_forest.op1_ann,
    "op2_toxicity": toxicity_cnn.op2_toxicity,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_language_id": langid_ecoc.op4_language_id,
    "op5_simhash": simhash_pivot.op5_simhash,
    "op6_line_dedup": line_runs.op6_line_dedup,
    "op7_byte_bpe": byte_bpe.op7_byte_bpe,
    "op8_html": html_tree.op8_html,
    "op9_media": jpeg_dc.op9_media,
    "op10_packing": bestfit_packing.op10_packing,
    "op11_source_divergence": source_audit.op11_source_divergence,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_line_quality": line_quality.op13_line_quality,
}

SQL = {
    "op3_chat_format": chat_format.OP3_SQL,
    "op6_line_dedup": line_runs.OP6_SQL,
    "op11_source_divergence": source_audit.OP11_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
    "op13_line_quality": line_quality.OP13_SQL,
}
