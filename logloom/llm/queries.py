"""The registered corpus queries and their SQL."""

from . import alignment, kdtree, minhash, mixing, multiindex, packing, prefix_trie, quality, resharding, rules, secret_scan, suffix, training_order  # noqa: F401
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
