"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from supplylens.llm import fim, html, jaccard, lots, neighbours, packing, pii, quality, secrets, sharding, transducer, trie, wavelet

MODULES = (secrets, packing, trie, html, wavelet, pii, neighbours, sharding, jaccard, quality, fim, transducer, lots)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
