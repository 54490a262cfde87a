"""Queries of the training-data operators, and SQL for those that SQL can express."""

from lumora.llm import htmltext, lm, mixing, neardup, packing, pii, quality, secrets, topk, toxicity

QUERIES = {
    "op1_lm_scoring": lm.op1_lm_scoring,
    "op2_near_duplicates": neardup.op2_near_duplicates,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_personal_data": pii.op4_personal_data,
    "op5_exact_top_k": topk.op5_exact_top_k,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_packing": packing.op7_packing,
    "op8_html_extraction": htmltext.op8_html_extraction,
    "op9_source_mixing": mixing.op9_source_mixing,
    "op10_quality_rules": quality.op10_quality_rules,
}

#: The others train models, round at random or tokenize; tests/llm holds them against brute force.
ORACLE_SQL = {"op2_near_duplicates": neardup.OP2_SQL, "op5_exact_top_k": topk.OP5_SQL}
