"""The queries of this package and their SQL."""

from __future__ import annotations

from textquarry.llm import block_anchors, bpe_prefix, edit_embedding, mixing, rotated_codes, secret_scan, simhash_anchors, toxicity, url_templates, warc_chunks

_MODULES = (warc_chunks, simhash_anchors, url_templates, toxicity, edit_embedding, secret_scan, mixing, bpe_prefix, rotated_codes, block_anchors)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLES.items()}
