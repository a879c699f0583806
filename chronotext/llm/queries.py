"""Importing this module registers every query of the subpackage."""

from chronotext.llm import balltree, chunks, crosspolytope, langid, mixing, negatives, packing, segments, simhash, suffixes, toxicity, variants, warc  # noqa: F401
from chronotext.llm.registry import QUERIES, SQL  # noqa: F401
