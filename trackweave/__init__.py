"""Mobility analytics on Spark DataFrames."""

from . import functions, operators, plans, sources
from .plans import Network

__all__ = ["Network", "functions", "operators", "plans", "sources"]
