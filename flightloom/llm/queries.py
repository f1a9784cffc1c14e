"""Queries and oracle SQL of the training-data operators, for ``__spark_entry__``."""

from __future__ import annotations

from flightloom.llm.binary_records import op2_binary_records
from flightloom.llm.bytebpe import op8_byte_bpe
from flightloom.llm.dart_minhash import op9_dart_minhash
from flightloom.llm.elkan_codes import ORACLE as ELKAN_ORACLE
from flightloom.llm.elkan_codes import op12_elkan_codes
from flightloom.llm.language_id import op10_language_mixture
from flightloom.llm.line_runs import ORACLE as LINE_ORACLE
from flightloom.llm.line_runs import op11_line_runs
from flightloom.llm.merkle_manifest import ORACLE as MERKLE_ORACLE
from flightloom.llm.merkle_manifest import op13_merkle_manifest
from flightloom.llm.packing import op4_packing
from flightloom.llm.quality_model import op6_quality_network
from flightloom.llm.quality_rules import op1_quality_rules
from flightloom.llm.suffix_dedup import op7_suffix_dedup
from flightloom.llm.topk_search import ORACLE, op3_block_topk
from flightloom.llm.toxicity import op5_toxicity_nnpu

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_binary_records": op2_binary_records,
    "op3_block_topk": op3_block_topk,
    "op4_packing": op4_packing,
    "op5_toxicity_nnpu": op5_toxicity_nnpu,
    "op6_quality_network": op6_quality_network,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_dart_minhash": op9_dart_minhash,
    "op10_language_mixture": op10_language_mixture,
    "op11_line_runs": op11_line_runs,
    "op12_elkan_codes": op12_elkan_codes,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLE_SQL: dict[str, str] = {"op3_block_topk": ORACLE, "op11_line_runs": LINE_ORACLE, "op12_elkan_codes": ELKAN_ORACLE, "op13_merkle_manifest": MERKLE_ORACLE}
