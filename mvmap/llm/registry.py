"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from mvmap.llm import decontaminate, idfile, licenses, line_dedup, near_dup, packing, quality_model, quality_rules, sharding, toxicity

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_virtual_slots": sharding.op2_virtual_slots,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_near_duplicates": near_dup.op7_near_duplicates,
    "op8_quality_model": quality_model.op8_quality_model,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_plane_files": idfile.op10_plane_files,
}

ORACLE_SQL: dict[str, str] = {
    "op6_quality_rules": quality_rules.OP6_SQL,
}
