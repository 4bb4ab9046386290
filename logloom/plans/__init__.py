"""Registered queries; importing the modules fills the catalog."""

from . import derive, files, filters, groups, lookups  # noqa: F401
from .catalog import ORACLES, QUERIES  # noqa: F401
