"""All registered queries of the subpackage and their SQL."""

from pricegrid.llm import (  # noqa: F401
    chat, exact_dedup, html_text, line_dedup, ngram_join, packing, pii, piece_coding, quality, ranked_search, sharding, toxicity,
    whitening)
from pricegrid.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
