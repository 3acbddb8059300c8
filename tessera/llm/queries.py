"""The queries of this subpackage, by name, and the SQL of those that SQL can express.

op5, op6, op12 and op13 have SQL. op1, op9 and op10 hold learned models, op2, op7 and op11 a tokenizer,
op3 and op8 need the offsets of non-overlapping matches and checks of what
they hold, op4 searches windows by impacts, which SQL cannot say. Each of these is
tested against a brute-force version, the library or, for op9, held-out
accuracy instead.
"""

from __future__ import annotations

from . import bpe, chat_format, collocations, decontamination, fill_in_middle, interpolated_lm, jaccard_join, packing, pii, quality_classifier, quality_rules, secrets, token_files

QUERIES = {
    "op1_interpolated_lm": interpolated_lm.op1_interpolated_lm,
    "op2_token_files": token_files.op2_token_files,
    "op3_pii": pii.op3_pii,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_bpe": bpe.op7_bpe,
    "op8_secrets": secrets.op8_secrets,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_best_fit_packing": packing.op11_best_fit_packing,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_collocations": collocations.op13_collocations,
}

ORACLE_SQL: dict[str, str] = {"op6_chat_format": chat_format.SQL, "op5_jaccard_join": jaccard_join.SQL, "op12_fill_in_middle": fill_in_middle.SQL, "op13_collocations": collocations.SQL}
