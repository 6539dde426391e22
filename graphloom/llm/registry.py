"""Queries of this subpackage and their SQL, for the driver."""

from __future__ import annotations

from graphloom.llm import bpe, changepoints, hosts, lines, manifest, packing, passages, quality, secrets, simhash, topk, toxicity, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_bpe_round_trip": bpe.op2_bpe_round_trip,
    "op3_substring_dedup": passages.op3_substring_dedup,
    "op4_simhash": simhash.op4_simhash,
    "op5_line_rules": lines.op5_line_rules,
    "op6_url_filter": hosts.op6_url_filter,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_packing": packing.op8_packing,
    "op9_secrets": secrets.op9_secrets,
    "op10_exact_topk": topk.op10_exact_topk,
    "op11_change_points": changepoints.op11_change_points,
    "op12_merkle_manifest": manifest.op12_merkle_manifest,
    "op13_warc": warc.op13_warc,
}

ORACLES = {
    "op5_line_rules": lines.ORACLE_SQL,
    "op6_url_filter": hosts.ORACLE_SQL,
    "op9_secrets": secrets.ORACLE_SQL,
    "op10_exact_topk": topk.ORACLE_SQL,
    "op11_change_points": changepoints.ORACLE_SQL,
    "op12_merkle_manifest": manifest.ORACLE_SQL,
    "op13_warc": warc.ORACLE_SQL,
}
