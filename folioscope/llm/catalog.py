"""The queries of this subpackage and the SQL for those that SQL can express."""

from . import context_tree, decontaminate, fill_in_middle, hard_negatives, language, licenses, line_dedup, main_text, media, mixing, near_dup, repeats, token_files

QUERIES = {
    "op1_media": media.op1_media,
    "op2_near_dup": near_dup.op2_near_dup,
    "op3_main_text": main_text.op3_main_text,
    "op4_context_tree": context_tree.op4_context_tree,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_language": language.op6_language,
    "op7_repeats": repeats.op7_repeats,
    "op8_licenses": licenses.op8_licenses,
    "op9_token_files": token_files.op9_token_files,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLES = {**near_dup.ORACLE, **decontaminate.ORACLE, **mixing.ORACLE, **line_dedup.ORACLE, **fill_in_middle.ORACLE, **hard_negatives.ORACLE}
