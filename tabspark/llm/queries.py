"""All queries of the package; importing the modules fills the registry."""

from tabspark.llm import (  # noqa: F401
    op1_quality, op2_warc, op3_ngram_join, op4_token_files, op5_packing, op6_neighbours, op7_suffix_dedup, op8_licences, op9_lm_scoring, op10_decontaminate,
    op11_periodic_runs, op12_sharding, op13_collocations,
)
from tabspark.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
