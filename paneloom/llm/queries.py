"""All queries of the training-data operators."""

from paneloom.llm import (
    centroids,
    exact_topk,
    graph_index,
    hard_negatives,
    jaccard_join,
    language,
    mixing,
    packing,
    preference,
    quality,
    templates,
    token_counts,
    token_files,
)
from paneloom.llm.shared import QUERIES, SQL

__all__ = [
    "QUERIES", "SQL", "centroids", "exact_topk", "graph_index", "hard_negatives", "jaccard_join", "language", "mixing", "packing", "preference", "quality",
    "templates", "token_counts", "token_files",
]
