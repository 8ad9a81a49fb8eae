"""Imports every module of numbered queries, which registers them."""

from wardline.llm import bagminhash, html_text, leaks, merkle, packing, phrases, pivots, quality, slots, suffix_arrays, toxicity, url_rules, voronoi  # noqa: F401
from wardline.llm.registry import ORACLE, QUERIES  # noqa: F401
