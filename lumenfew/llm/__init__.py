"""Training-data operators. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenfew.llm import lexical, mixing, multiindex, negatives, packing, pitman_yor, quality, simhash, suffix, syncmers, tokencount, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_packing": packing.op2_packing,
        "op3_suffix_dedup": suffix.op3_suffix_dedup,
        "op4_token_counts": tokencount.op4_token_counts,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_warc": warc.op6_warc,
        "op7_language_model": pitman_yor.op7_language_model,
        "op8_simhash": simhash.op8_simhash,
        "op9_syncmers": syncmers.op9_syncmers,
        "op10_quality_rules": quality.op10_quality_rules,
        "op11_hard_negatives": negatives.op11_hard_negatives,
        "op12_nearest_neighbours": multiindex.op12_nearest_neighbours,
        "op13_lexical_search": lexical.op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.OP1_SQL, "op11_hard_negatives": negatives.OP11_SQL, "op12_nearest_neighbours": multiindex.OP12_SQL, "op13_lexical_search": lexical.OP13_SQL}
