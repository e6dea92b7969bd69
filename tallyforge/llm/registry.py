"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import collocations, decontaminate, langid, lines, pieces, quality, resample, sharding, simhash, substring, topk, toxicity, warc

QUERIES = {
    "op1_shards": sharding.query,
    "op2_decontaminate": decontaminate.query,
    "op3_language": langid.query,
    "op4_topk": topk.query,
    "op5_simhash": simhash.query,
    "op6_lines": lines.query,
    "op7_pieces": pieces.query,
    "op8_warc": warc.query,
    "op9_substring": substring.query,
    "op10_quality": quality.query,
    "op11_resample": resample.query,
    "op12_collocations": collocations.query,
    "op13_toxicity": toxicity.query,
}
ORACLE_SQL: dict[str, str] = {
    "op4_topk": topk.SQL,
    "op8_warc": warc.SQL,
    "op11_resample": resample.SQL,
    "op12_collocations": collocations.SQL,
}
