"""Registered queries of the gridded risk operators and their SQL counterparts."""

from gridrisk.plans.oracles import ORACLES
from gridrisk.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
