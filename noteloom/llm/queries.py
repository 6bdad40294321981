"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import bpe, centroids, fixed_parts, main_text, neardup, packing, phrases, ppm, quality, secrets, suffixes, token_files, topk, urls

MODULES = (suffixes, secrets, neardup, quality, bpe, packing, topk, token_files, urls, ppm, main_text, phrases, centroids, fixed_parts)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
