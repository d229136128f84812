"""Registered queries; importing this package fills the registry."""

from ..registry import QUERIES
from . import aggregates, diffs, graphs, joins, render, scans, selection, streams

FLAGSHIP = QUERIES["tolerance_compare"]
