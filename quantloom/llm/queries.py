"""Registered queries of the corpus operators, over whole tables, and their SQL where there is some."""

from __future__ import annotations

from quantloom.llm.chat import op9_chat_formatting
from quantloom.llm.cotraining import op2_quality_classifier
from quantloom.llm.decontaminate import op6_benchmark_decontamination
from quantloom.llm.line_dedup import op3_line_dedup
from quantloom.llm.manifest import op12_merkle_dataset_manifest
from quantloom.llm.minhash import op5_minhash_near_dedup
from quantloom.llm.oracles import ORACLES as ORACLES
from quantloom.llm.packing import op1_best_fit_packing
from quantloom.llm.quality_rules import op8_quality_rules
from quantloom.llm.repeats import op4_suffix_array_dedup
from quantloom.llm.secrets import op7_secret_scans
from quantloom.llm.spelling import op13_spelling_variant_grouping
from quantloom.llm.toxicity import op10_toxicity
from quantloom.llm.url_filter import op11_url_filters

QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_quality_classifier,
        op3_line_dedup,
        op4_suffix_array_dedup,
        op5_minhash_near_dedup,
        op6_benchmark_decontamination,
        op7_secret_scans,
        op8_quality_rules,
        op9_chat_formatting,
        op10_toxicity,
        op11_url_filters,
        op12_merkle_dataset_manifest,
        op13_spelling_variant_grouping,
    )
}
