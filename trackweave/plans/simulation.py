"""Synthetic walks from observed starts and an observed matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..lineage import store
from ..operators.trajectories import start_cells
from ..operators.walks import synthesize_walks
from .layout import Slot
from .matrices import trajectory, transition_matrix
from .network import Network


def observed_walks(
    observations: DataFrame,
    network: Network,
    steps: int,
    order: int = 1,
    slot: Slot | None = None,
    seed: int = 0,
) -> DataFrame:
    """One walk (user_id, walk) per user, from the user's first cell."""
    starts = start_cells(trajectory(observations, network, order, slot))
    matrix = transition_matrix(observations, network, order, slot)
    return store(synthesize_walks(starts, matrix, steps, seed))
