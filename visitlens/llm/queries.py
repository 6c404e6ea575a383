"""The registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from visitlens.llm.duckbpe import op12_duckdb_bpe
from visitlens.llm.licenses import license_sql, op5_license_index
from visitlens.llm.lines import lines_sql, op7_repeated_line_runs
from visitlens.llm.media import op9_media_columns
from visitlens.llm.negatives import negatives_sql, op11_hard_negatives
from visitlens.llm.packing import op10_cutting_stock_packing
from visitlens.llm.pieces import op2_sentencepiece_unigram
from visitlens.llm.quality import op4_nbsvm_quality
from visitlens.llm.repair import op6_repair_token_ids
from visitlens.llm.rules import op3_decision_list_rules
from visitlens.llm.simhash import op8_simhash_near_duplicates
from visitlens.llm.spelling import op13_spelling_variants
from visitlens.llm.toxicity import op1_kneser_ney_toxicity

QUERIES = {
    "op1_kneser_ney_toxicity": op1_kneser_ney_toxicity,
    "op2_sentencepiece_unigram": op2_sentencepiece_unigram,
    "op3_decision_list_rules": op3_decision_list_rules,
    "op4_nbsvm_quality": op4_nbsvm_quality,
    "op5_license_index": op5_license_index,
    "op6_repair_token_ids": op6_repair_token_ids,
    "op7_repeated_line_runs": op7_repeated_line_runs,
    "op8_simhash_near_duplicates": op8_simhash_near_duplicates,
    "op9_media_columns": op9_media_columns,
    "op10_cutting_stock_packing": op10_cutting_stock_packing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_duckdb_bpe": op12_duckdb_bpe,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {"op5_license_index": license_sql(), "op7_repeated_line_runs": lines_sql(), "op11_hard_negatives": negatives_sql()}
