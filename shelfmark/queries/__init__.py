"""Queries over the test tables, each beside its SQL."""

from . import catalog, chunks, jobs, retrieval, stats, text
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalog", "chunks", "jobs", "retrieval", "stats", "text"]
