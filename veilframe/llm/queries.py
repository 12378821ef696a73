"""Registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import bagminhash, curriculum, fill_middle, license_scan, packing, rabitq, risk_rules, source_audit, suffix_dedup, template_extract, token_counts, warc, weak_quality

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_mixture_packing": packing.op2_mixture_packing,
    "op3_warc_revisits": warc.op3_warc_revisits,
    "op4_bagminhash": bagminhash.op4_bagminhash,
    "op5_curriculum_mix": curriculum.op5_curriculum_mix,
    "op6_rotated_codes": rabitq.op6_rotated_codes,
    "op7_risk_rules": risk_rules.op7_risk_rules,
    "op8_template_extract": template_extract.op8_template_extract,
    "op9_weak_quality": weak_quality.op9_weak_quality,
    "op10_license_scan": license_scan.op10_license_scan,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_source_audit": source_audit.op12_source_audit,
    "op13_token_counts": token_counts.op13_token_counts,
}
ORACLES: dict[str, str] = {
    "op3_warc_revisits": warc.ORACLE,
    "op5_curriculum_mix": curriculum.ORACLE,
    "op6_rotated_codes": rabitq.ORACLE,
    "op7_risk_rules": risk_rules.ORACLE,
    "op10_license_scan": license_scan.ORACLE,
    "op11_fill_middle": fill_middle.ORACLE,
    "op12_source_audit": source_audit.ORACLE,
}
