"""Readers and writers."""

from .rings import (
    adjacency_from_records,
    number_lines,
    parse_ring_lines,
    read_ring_adjacency,
    read_ring_records,
)
from .tables import CELL_FILE, OBSERVATION_FILE, read_cells, read_observations, write_matrix

__all__ = [
    "CELL_FILE",
    "OBSERVATION_FILE",
    "adjacency_from_records",
    "number_lines",
    "parse_ring_lines",
    "read_cells",
    "read_observations",
    "read_ring_adjacency",
    "read_ring_records",
    "write_matrix",
]
