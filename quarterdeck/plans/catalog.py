"""Every registered query and its checking SQL, by name."""

from . import accounts, holdings, intake, portfolios, records, research  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
