"""The corpus operators' queries and the SQL that checks them, for registration."""

from . import decontaminate, divergence, exact_dedup, language_id, licenses, mixing, phrase_dedup, pii, simhash, spelling, suffix_dedup, topk, url_rules

_MODULES = (licenses, language_id, url_rules, simhash, decontaminate, topk, phrase_dedup, suffix_dedup, mixing, pii, spelling, exact_dedup, divergence)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
