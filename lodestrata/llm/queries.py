"""The registered queries of the text operators."""

from __future__ import annotations

from . import codes, decontam, fingerprint, html, infill, langid, lines, lm, neardup, packing, suffix, toxicity, warc

QUERIES = {
    "op1_fingerprints": fingerprint.op1_fingerprints,
    "op2_decontaminate": decontam.op2_decontaminate,
    "op3_warc": warc.op3_warc,
    "op4_minhash_near_dedup": neardup.op4_minhash_near_dedup,
    "op5_suffix_array_dedup": suffix.op5_suffix_array_dedup,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_language_id": langid.op7_language_id,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_html_extraction": html.op9_html_extraction,
    "op10_lm_scoring": lm.op10_lm_scoring,
    "op11_vector_codes": codes.op11_vector_codes,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_fill_in_middle": infill.op13_fill_in_middle,
}
ORACLE_SQL = {
    "op2_decontaminate": decontam.OP2_SQL,
    "op3_warc": warc.OP3_SQL,
    "op4_minhash_near_dedup": neardup.OP4_SQL,
    "op6_line_dedup": lines.OP6_SQL,
    "op11_vector_codes": codes.OP11_SQL,
    "op13_fill_in_middle": infill.OP13_SQL,
}
