"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import chat, decontaminate, fingerprints, layout, licenses, mixing, passages, pii, quality, simhash_dedup, spelling, substrings, url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_minhash_licenses": licenses.op1_minhash_licenses,
        "op2_suffix_automaton": decontaminate.op2_suffix_automaton,
        "op3_collinear_chains": passages.op3_collinear_chains,
        "op4_pivot_simhash": simhash_dedup.op4_pivot_simhash,
        "op5_random_indexing": quality.op5_random_indexing,
        "op6_induced_sorting": substrings.op6_induced_sorting,
        "op7_budgeted_windows": chat.op7_budgeted_windows,
        "op8_char_bilstm_crf": pii.op8_char_bilstm_crf,
        "op9_pareto_mixing": mixing.op9_pareto_mixing,
        "op10_simhash_fingerprints": fingerprints.op10_simhash_fingerprints,
        "op11_counting_bisection": layout.op11_counting_bisection,
        "op12_rarest_token": url_filters.op12_rarest_token,
        "op13_halves_automata": spelling.op13_halves_automata,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_automaton": decontaminate.ORACLE, "op9_pareto_mixing": mixing.ORACLE, "op11_counting_bisection": layout.ORACLE, "op12_rarest_token": url_filters.ORACLE, "op13_halves_automata": spelling.ORACLE}
