"""The subpackage's queries and their SQL."""

from . import clusters, decontaminate, divergence, edit_prints, html_text, lang_id, line_dedup, maglev, packing, quality, simhash, suffix_dedup, token_files

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_suffix_dedup": suffix_dedup.query,
    "op3_html_text": html_text.query,
    "op4_decontaminate": decontaminate.query,
    "op5_maglev_sharding": maglev.query,
    "op6_quality": quality.query,
    "op7_simhash": simhash.query,
    "op8_lang_id": lang_id.query,
    "op9_best_fit_packing": packing.query,
    "op10_edit_prints": edit_prints.query,
    "op11_divergence": divergence.query,
    "op12_token_files": token_files.query,
    "op13_delta_lloyd": clusters.query,
    "edit_print_classes": edit_prints.classes_query,  # second half of operator 10: bands and verification
}

ORACLE = {
    "op1_line_dedup": line_dedup.SQL,
    "op2_suffix_dedup": suffix_dedup.SQL,
    "op4_decontaminate": decontaminate.SQL,
    "op11_divergence": divergence.SQL,
    "op13_delta_lloyd": clusters.SQL,
}
