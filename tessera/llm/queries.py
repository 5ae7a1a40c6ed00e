"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from tessera.llm import bpe, exact_dedup, fingerprints, language_id, lattice, licenses, packing, simhash, substring_dedup, warc

MODULES = (substring_dedup, language_id, warc, licenses, fingerprints, exact_dedup, simhash, lattice, bpe, packing)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
