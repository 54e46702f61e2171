"""Queries of the text operators and the pipeline, and their SQL where SQL can express them.

Without SQL: packing, near-duplicates, PII, suffix arrays, language ID, substring
dedup, decontamination and toxicity are tested against brute force.
"""

from __future__ import annotations

import corpus_pipeline

from . import (automaton, chat_format, conversation_repair, decontaminate, fill_in_middle, lang_ppm, line_dedup, minhash,
               packing, pii, quality_rules, suffix_array, toxicity)

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_near_duplicates": minhash.op2_near_duplicates,
    "op3_suffix_array": suffix_array.op3_suffix_array,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_pii": pii.op5_pii,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_language_id": lang_ppm.op8_language_id,
    "op9_substring_dedup": automaton.op9_substring_dedup,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_toxicity": toxicity.op13_toxicity,
    "pipeline": corpus_pipeline.run,
}

ORACLE = {
    "op4_chat_format": chat_format.ORACLE,
    "op6_quality_rules": quality_rules.oracle(),
    "op7_line_dedup": line_dedup.ORACLE,
    "op11_conversation_repair": conversation_repair.ORACLE,
    "op12_fill_in_middle": fill_in_middle.ORACLE,
    **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}),
}
