"""Starting distributions and their propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import store
from ..operators.markov import chain_phases, initial_distribution
from ..operators.trajectories import start_cells
from .layout import Slot, StoredTrajectory, store_trajectory
from .matrices import slot_matrices, trajectory
from .network import Network


def starting_distribution(
    observations: DataFrame | StoredTrajectory, network: Network, order: int = 0, slot: Slot | None = None
) -> DataFrame:
    """Mean first state of the users as (cell_no, p)."""
    starts = start_cells(trajectory(observations, network, order, slot))
    return initial_distribution(starts, network.links(order) if order else None)


def slot_phases(
    observations: DataFrame | StoredTrajectory,
    network: Network,
    slots: list[Slot],
    rows: list[int],
    order: int = 1,
) -> DataFrame:
    """Propagate the first slot's start through one matrix per slot.

    Returns (phase, step, cell_no, p). The matrices of all slots come from one scan of
    the stored trajectory; raw observations are stored that way first.
    """
    if not isinstance(observations, StoredTrajectory):
        observations = store_trajectory(observations, network)
    start = store(starting_distribution(observations, network, order, slots[0]))
    matrices = store(slot_matrices(observations, slots, order))
    phases = [(matrices.filter(F.col("slot") == place), n) for place, n in enumerate(rows)]
    return chain_phases(start, phases)
