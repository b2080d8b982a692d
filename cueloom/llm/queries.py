"""All registered queries of this subpackage."""

from cueloom.llm import (  # noqa: F401
    query_bpe,
    query_chat,
    query_filters,
    query_jaccard,
    query_lines,
    query_packing,
    query_paragraphs,
    query_quality,
    query_search,
    query_shards,
    query_token_files,
    query_toxicity,
    query_winnow,
)
from cueloom.llm.registry import PLANS, SQL

__all__ = ["PLANS", "SQL"]
