"""All queries of this subpackage."""

from ledgerlens.llm import (  # noqa: F401  (importing registers the queries)
    bpe_chunks,
    context_mixing,
    exact_dedup,
    jaccard_join,
    line_runs,
    packing,
    personal_data,
    prefix_trie,
    quality_density,
    quality_rules,
    ring_shards,
    secret_links,
    structure_repair,
)
from ledgerlens.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
