"""The subpackage's queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import op1_covertree, op2_secrets, op3_warc, op4_packing, op5_lines, op6_minhash, op7_quality, op8_bpe, op9_toxicity, op10_html, op11_spelling, op12_conversations, op13_mixing

QUERIES = {
    "op1_cover_tree_topk": op1_covertree.query,
    "op2_secret_scan": op2_secrets.query,
    "op3_warc_normaliser": op3_warc.query,
    "op4_dp_packing": op4_packing.query,
    "op5_line_frequency": op5_lines.query,
    "op6_minhash_bayes": op6_minhash.query,
    "op7_importance_resampling": op7_quality.query,
    "op8_bpe_transducer": op8_bpe.query,
    "op9_toxic_segments": op9_toxicity.query,
    "op10_text_density": op10_html.query,
    "op11_spelling_variants": op11_spelling.query,
    "op12_conversation_repair": op12_conversations.query,
    "op13_source_mixing": op13_mixing.query,
}

ORACLE_SQL = {
    "op1_cover_tree_topk": op1_covertree.ORACLE,
    "op3_warc_normaliser": op3_warc.ORACLE,
    "op5_line_frequency": op5_lines.ORACLE,
    "op6_minhash_bayes": op6_minhash.ORACLE,
    "op13_source_mixing": op13_mixing.ORACLE,
}
