"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import divergence, exact_dedup, langid, manifest, merkle, minhash, mixing, packing, quality, simhash, substring, suffix, toxicity

QUERIES = {
    "op1_substring": substring.op1_substring,
    "op2_suffix": suffix.op2_suffix,
    "op3_quality": quality.op3_quality,
    "op4_mixing": mixing.op4_mixing,
    "op5_packing": packing.op5_packing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_simhash": simhash.op8_simhash,
    "op9_langid": langid.op9_langid,
    "op10_merkle": merkle.op10_merkle,
    "op11_manifest": manifest.op11_manifest,
    "op12_divergence": divergence.op12_divergence,
    "op13_minhash": minhash.op13_minhash,
}
ORACLES = {
    "op4_mixing": mixing.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op11_manifest": manifest.ORACLE,
    "op12_divergence": divergence.ORACLE,
}
