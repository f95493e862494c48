"""The corpus operators' queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from . import chat_format, decontaminate, lm_scoring, near_dedup, packing, pii, quality_classifier, quality_rules, token_counts, toxicity


def queries() -> dict[str, Callable]:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_quality_classifier": quality_classifier.op2_quality_classifier,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_chat_format": chat_format.op4_chat_format,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_lm_scoring": lm_scoring.op6_lm_scoring,
        "op7_pii": pii.op7_pii,
        "op8_best_fit_packing": packing.op8_best_fit_packing,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_near_dedup": near_dedup.op10_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": decontaminate.OP1_SQL, "op4_chat_format": chat_format.OP4_SQL}
