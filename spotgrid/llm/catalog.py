"""All queries of this subpackage."""

from spotgrid.llm import balltree, chat, jaccard_trees, mixing, pieces, quality_crf, quality_rules, sharding, simhash, spelling, token_files, vector_codes, warc  # noqa: F401
from spotgrid.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
