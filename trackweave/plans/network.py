"""The cell network: numbered cells and their ring neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..lineage import store
from ..operators.cells import number_cells
from ..operators.dimensions import Dimension, measure
from ..operators.rings import (
    number_distribution,
    ring_distribution,
    states_from_distribution,
)


class Network:
    """Cells and adjacency, computed and counted once and then shared by plans.

    ``cells`` has (cell_id, coord_x, coord_y); ``adjacency`` has (cell_id,
    neighbor_id, ring_order) with an order-0 row per cell.
    """

    def __init__(self, cells: DataFrame, adjacency: DataFrame | None = None) -> None:
        if "cell_no" not in cells.columns:
            cells = store(number_cells(store(cells)))
        self.cells: Dimension = measure(cells)
        places = self.cells.df.select("coord_x", "coord_y").distinct().count()
        self.shared_coordinates: bool = places < self.cells.rows
        self.adjacency = None if adjacency is None else store(adjacency)
        self._links: dict[int, Dimension] = {}
        self._states: dict[int, Dimension] = {}
        self._distributions: dict[int, Dimension] = {}
        self._ringed: Dimension | None = None

    def links(self, order: int) -> Dimension:
        """Ring distribution on cell numbers (cell_no, link_no, prop)."""
        if order not in self._links:
            spread = number_distribution(ring_distribution(self.adjacency, order), self.cells)
            self._links[order] = measure(store(spread))
        return self._links[order]

    def distribution(self, order: int) -> Dimension:
        """Ring distribution on cell ids (cell_id, neighbor_id, prop)."""
        if order not in self._distributions:
            self._distributions[order] = measure(store(ring_distribution(self.adjacency, order)))
        return self._distributions[order]

    def states(self, order: int) -> Dimension:
        """Ring states (cell_id, states)."""
        if order not in self._states:
            packed = states_from_distribution(ring_distribution(self.adjacency, order))
            self._states[order] = measure(store(packed))
        return self._states[order]

    def ringed_cells(self) -> Dimension:
        """The cells that have a ring."""
        if self._ringed is None:
            listed = self.adjacency.select("cell_id").distinct()
            self._ringed = measure(store(self.cells.df.join(listed, "cell_id", "left_semi")))
        return self._ringed
