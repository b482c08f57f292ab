"""Operators: functions from DataFrames to a DataFrame."""

from .cells import locate_observations, normalize_cells, number_cells
from .dimensions import Dimension, join_null_safe, lookup_join, measure
from .markov import (
    chain_phases,
    convergence_distance,
    convergence_trace,
    initial_distribution,
    mobility_trend,
    propagate,
    propagate_all,
    simplify_vector_ids,
    to_vector,
    vector_collect,
)
from .matrix import (
    collect_pairs,
    count_pairs,
    explode_updates,
    gis_export,
    matrix_coo,
    row_normalize,
    simplify_matrix_ids,
    spread_pairs,
    spread_pairs_by_id,
)
from .observations import (
    dedup_observations,
    drop_incomplete,
    filter_time_slot,
    normalize_observations,
    sort_observations,
    tag_slots,
)
from .pairs import (
    hot_user_days,
    lag_state_by_day,
    lag_state_by_second,
    od_destination,
    od_destination_by_second,
    split_user_days,
    with_day,
)
from .rings import (
    ORDERS,
    align_ring_counts,
    align_ring_members,
    complete_records,
    join_ring_parts,
    number_distribution,
    records_from_adjacency,
    ring_distribution,
    ring_probability,
    ring_repeat_weights,
    ring_states,
    states_from_distribution,
)
from .sequences import day_shifts, lag_state_by_step, number_steps
from .trajectories import (
    deterministic_states,
    explode_states,
    first_observation,
    pair_states,
    probabilistic_states,
    start_cells,
)
from .walks import (
    add_ring_noise,
    count_walk_pairs,
    draw_table,
    last_step_distribution,
    next_state_draw,
    random_states,
    running_mean,
    running_mean_at,
    running_sums,
    step_mean,
    synthesize_walks,
    transition_cdf,
    walk_to_rows,
    walk_vectors,
)

__all__ = [name for name in dir() if not name.startswith("_")]
