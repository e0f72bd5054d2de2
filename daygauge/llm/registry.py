"""Imports every module that registers a query."""

from daygauge.llm import conversations, mixing, nearest, packing, pages, pieces, piecewise, quality, sharding, simhash, substrings, toxicity, whitening  # noqa: F401
from daygauge.llm.common import ORACLES, QUERIES  # noqa: F401
