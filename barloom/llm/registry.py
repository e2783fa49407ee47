"""Queries of this subpackage, and their SQL where SQL can express them."""

from barloom.llm import alignment, bpe, importance, minhash, packing, pii, quality_rules, records, secret_scan, simhash, sketch, toxicity, weak_quality

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_weak_quality": weak_quality.op2_weak_quality,
    "op3_packing": packing.op3_packing,
    "op4_records": records.op4_records,
    "op5_secrets": secret_scan.op5_secrets,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_minhash": minhash.op7_minhash,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_bpe": bpe.op9_bpe,
    "op10_pii": pii.op10_pii,
    "op11_importance": importance.op11_importance,
    "op12_fast_sketch": sketch.op12_fast_sketch,
    "op13_alignment": alignment.op13_alignment,
}

ORACLE_SQL = {
    "op8_quality_rules": quality_rules.ORACLE_SQL,
    "op11_importance": importance.ORACLE_SQL,
}
