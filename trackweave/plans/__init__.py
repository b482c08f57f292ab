"""Pipelines from observations to matrices, distributions and walks."""

from .distributions import slot_phases, starting_distribution
from .layout import StoredTrajectory, store_trajectory
from .matrices import (
    matrix_from_pairs,
    od_matrix,
    sequence,
    slot_matrices,
    slot_pairs,
    trajectory,
    transition_matrix,
    transition_matrix_steps,
    transition_matrix_walks,
    transition_pairs,
)
from .network import Network
from .simulation import observed_walks

__all__ = [
    "Network",
    "StoredTrajectory",
    "matrix_from_pairs",
    "observed_walks",
    "od_matrix",
    "sequence",
    "slot_matrices",
    "slot_pairs",
    "slot_phases",
    "store_trajectory",
    "starting_distribution",
    "trajectory",
    "transition_matrix",
    "transition_matrix_steps",
    "transition_matrix_walks",
    "transition_pairs",
]
