"""The dealt operators' queries by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import chat, collocations, decontam, extract, licences, merkle, mix, nbsvm, neardup, rules, secrets, shard, suffix

QUERIES = {
    "op1_bottomk_neardup": neardup.op1_bottomk_neardup,
    "op2_two_pass_blocks": extract.op2_two_pass_blocks,
    "op3_risk_controlled_rules": rules.op3_risk_controlled_rules,
    "op4_nbsvm_quality": nbsvm.op4_nbsvm_quality,
    "op5_blob_ledger_scan": secrets.op5_blob_ledger_scan,
    "op6_budgeted_windows": chat.op6_budgeted_windows,
    "op7_sparse_suffix_dedup": suffix.op7_sparse_suffix_dedup,
    "op8_suffix_automaton_decontamination": decontam.op8_suffix_automaton_decontamination,
    "op9_raked_mixture": mix.op9_raked_mixture,
    "op10_stratified_shards": shard.op10_stratified_shards,
    "op11_trie_collocations": collocations.op11_trie_collocations,
    "op12_licence_templates": licences.op12_licence_templates,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}
ORACLE_SQL = {**rules.ORACLE, **secrets.ORACLE, **chat.ORACLE, **decontam.ORACLE, **mix.ORACLE, **collocations.ORACLE, **merkle.ORACLE}
