"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from vacantia.llm import exact_dedup, hard_negatives, quality_rules, url_filter
from vacantia.llm.exact_dedup import op3_exact_dedup
from vacantia.llm.hard_negatives import op12_hard_negatives
from vacantia.llm.jaccard_join import op1_ngram_jaccard_join
from vacantia.llm.minhash import op13_minhash_dedup
from vacantia.llm.mixing import op9_source_mixing
from vacantia.llm.packing import op6_best_fit_packing
from vacantia.llm.pii import op8_personal_data
from vacantia.llm.quality_classifier import op10_quality_classifier
from vacantia.llm.quality_rules import op5_quality_rules
from vacantia.llm.repeats import op4_suffix_repeats
from vacantia.llm.spelling import op11_spelling_variants
from vacantia.llm.token_counts import op7_edit_aware_token_counts
from vacantia.llm.url_filter import op2_url_filter


def queries() -> dict:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_url_filter": op2_url_filter,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_suffix_repeats": op4_suffix_repeats,
        "op5_quality_rules": op5_quality_rules,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_edit_aware_token_counts": op7_edit_aware_token_counts,
        "op8_personal_data": op8_personal_data,
        "op9_source_mixing": op9_source_mixing,
        "op10_quality_classifier": op10_quality_classifier,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_minhash_dedup": op13_minhash_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": url_filter.ORACLE, "op3_exact_dedup": exact_dedup.ORACLE, "op5_quality_rules": quality_rules.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE}
