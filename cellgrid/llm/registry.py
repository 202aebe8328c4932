"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import jaccard_join, mixing, phrase_tries
from .brown_lm import op10_brown_lm
from .decision_list import op8_decision_list
from .guess_cost import op4_guess_cost_secrets
from .jaccard_join import op5_ngram_jaccard
from .mixing import op1_mixing
from .periodic_runs import op12_periodic_runs
from .phrase_tries import op11_phrase_collocations
from .quality_gam import op6_quality_gam
from .rank_profiles import op13_language_id
from .ring_shards import op3_ring_shards
from .template_decon import op7_template_decon
from .token_counts import op9_token_counts
from .token_files import op2_bitplane_tokens


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each operator applied to its whole table."""
    found = (
        op1_mixing, op2_bitplane_tokens, op3_ring_shards, op4_guess_cost_secrets, op5_ngram_jaccard, op6_quality_gam, op7_template_decon,
        op8_decision_list, op9_token_counts, op10_brown_lm, op11_phrase_collocations, op12_periodic_runs, op13_language_id,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {"op1_mixing": mixing.oracle_sql(), "op5_ngram_jaccard": jaccard_join.oracle_sql(), "op11_phrase_collocations": phrase_tries.oracle_sql()}
