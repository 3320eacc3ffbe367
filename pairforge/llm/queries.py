"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pairforge.llm import chat, decontaminate, exact_dedup, filter_audit, language, licenses, mixing, resampling, simhash, substring_dedup, token_counts, tokens, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        substring_dedup.op1_substring_dedup,
        language.op2_language,
        mixing.op3_mixing,
        chat.op4_chat_format,
        exact_dedup.op5_exact_dedup,
        licenses.op6_license_scan,
        toxicity.op7_toxicity,
        simhash.op8_simhash,
        decontaminate.op9_decontaminate,
        tokens.op10_tokens,
        token_counts.op11_token_counts,
        resampling.op12_resampling,
        filter_audit.op13_filter_audit,
    )
}

ORACLES = {"op1_substring_dedup": substring_dedup.OP1_SQL, "op4_chat_format": chat.OP4_SQL, "op5_exact_dedup": exact_dedup.OP5_SQL, "op13_filter_audit": filter_audit.OP13_SQL}
