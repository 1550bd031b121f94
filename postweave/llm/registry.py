"""Queries and oracle SQL of this subpackage, by name."""

from __future__ import annotations

from . import (decontamination, divergence, exact_dedup, fingerprints, jaccard_join, language, mixing, packing, secrets, sharding, spelling,
               substring_dedup, toxicity)

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_sharding": sharding.op3_sharding,
    "op4_mixing": mixing.op4_mixing,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_secrets": secrets.op7_secrets,
    "op8_language": language.op8_language,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_fingerprints": fingerprints.op10_fingerprints,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_decontamination": decontamination.op13_decontamination,
}

ORACLE_SQL = {
    "op2_exact_dedup": exact_dedup.ORACLE_SQL,
    "op5_jaccard_join": jaccard_join.ORACLE_SQL,
    "op9_substring_dedup": substring_dedup.ORACLE_SQL,
    "op11_spelling_variants": spelling.ORACLE_SQL,
    "op12_source_divergence": divergence.ORACLE_SQL,
    "op13_decontamination": decontamination.ORACLE_SQL,
}
