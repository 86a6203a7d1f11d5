"""Registers one query for each operator."""

from . import crosstoken, lines, mixing, packing, quality, resample, sharding, simhash, substring, suffix, template, topk, trie  # noqa: F401
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
