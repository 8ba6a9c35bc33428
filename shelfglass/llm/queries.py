"""All queries of this subpackage."""

from shelfglass.llm import (  # noqa: F401
    cotraining,
    hard_negatives,
    hnsw,
    jaccard_join,
    line_chunks,
    mixing,
    packing,
    secret_scan,
    simhash,
    spelling,
    token_counts,
    toxicity,
    warc,
)
from shelfglass.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
