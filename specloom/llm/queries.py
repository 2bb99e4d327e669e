"""Queries of this subpackage for ``__spark_entry__``, and their SQL where there is one."""

from __future__ import annotations

from . import chat_format, filter_audit, interpolated_lm, line_dedup, minhash, mixing, neighbour_graph, pieces, quality_model, quality_rules, source_divergence, token_files, warc

QUERIES = {
    "op1_warc_index": warc.op1_warc_index,
    "op2_nn_descent": neighbour_graph.op2_nn_descent,
    "op3_merge_dropout": pieces.op3_merge_dropout,
    "op4_nbsvm": quality_model.op4_nbsvm,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_minhash": minhash.op6_minhash,
    "op7_weighted_mix": mixing.op7_weighted_mix,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_separator_scan": token_files.op10_separator_scan,
    "op11_source_divergence": source_divergence.op11_source_divergence,
    "op12_interpolated_lm": interpolated_lm.op12_interpolated_lm,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLE_SQL = {
    "op1_warc_index": warc.OP1_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op7_weighted_mix": mixing.OP7_SQL,
    "op8_chat_format": chat_format.OP8_SQL,
    "op9_quality_rules": quality_rules.OP9_SQL,
    "op11_source_divergence": source_divergence.OP11_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
