"""Registered queries over the given tables, each with its SQL statement where one exists."""

from .registry import ORACLES, QUERIES, load_all

__all__ = ["ORACLES", "QUERIES", "load_all"]
