"""The registered queries of this subpackage and their DuckDB equivalents."""

from foralia.llm import (
    html_text,
    importance,
    language_model,
    line_dedup,
    media,
    mixing,
    packing,
    quality,
    ranked_search,
    simhash,
    suffix_dedup,
    token_files,
    toxicity,
)

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_language_model": language_model.op2_language_model,
    "op3_media": media.op3_media,
    "op4_mixing": mixing.op4_mixing,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_html": html_text.op7_html,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_packing": packing.op9_packing,
    "op10_quality": quality.op10_quality,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_importance": importance.op12_importance,
    "op13_token_files": token_files.op13_token_files,
}

ORACLES = {
    "op4_mixing": mixing.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op11_ranked_search": ranked_search.ORACLE,
    "op12_importance": importance.ORACLE,
}
