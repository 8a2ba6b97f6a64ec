"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from probitas.llm import alignment, chat, classifier, decontaminate, mixing, periodic, ppm, private, quality_rules, sharding, simhash, token_files, url_filter


def queries() -> dict:
    found = (
        decontaminate.op1_benchmark_decontamination, url_filter.op2_url_filter, quality_rules.op3_quality_rules,
        ppm.op4_ppm_scoring, token_files.op5_token_files, sharding.op6_sharding, mixing.op7_source_mixing,
        classifier.op8_quality_classifier, simhash.op9_simhash_near_dedup, chat.op10_chat_formatting,
        periodic.op11_periodic_runs, private.op12_personal_data, alignment.op13_tokenizer_alignment,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": url_filter.oracle(),
        "op3_quality_rules": quality_rules.oracle(),
        "op7_source_mixing": mixing.oracle(),
        "op10_chat_formatting": chat.oracle(),
        "op11_periodic_runs": periodic.oracle(),
    }
