"""The registered queries of this subpackage and their oracles."""

from __future__ import annotations

from . import (decontaminate, html_text, language_crf, near_dup, pitman_yor, quality_net, quality_rules, sentencepiece_ops, spelling_variants,  # noqa: F401
               token_counts, toxicity, vector_codes, warc)
from .shared import ORACLES, QUERIES


def llm_queries() -> dict:
    return dict(QUERIES)


def llm_oracles() -> dict[str, str]:
    return dict(ORACLES)
