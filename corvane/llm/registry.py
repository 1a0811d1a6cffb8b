"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from corvane.llm import compress, decontam, html_main, lang_id, licenses, lm_score, mixing, mtree, near_dup, pieces, secrets, spelling, warc

_MODULES = (secrets, decontam, near_dup, lang_id, lm_score, warc, mixing, mtree, html_main, licenses, spelling, pieces, compress)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
