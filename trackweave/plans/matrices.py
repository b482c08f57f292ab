"""Transition and origin-destination matrices from observations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cells import locate_observations
from ..operators.dimensions import Dimension, lookup_join
from ..operators.matrix import count_pairs, row_normalize, spread_pairs
from ..operators.observations import (
    dedup_observations,
    drop_incomplete,
    filter_time_slot,
    tag_slots,
)
from ..operators.pairs import (
    hot_user_days,
    lag_state_by_day,
    lag_state_by_second,
    od_destination,
    od_destination_by_second,
    split_user_days,
    with_day,
)
from ..operators.sequences import lag_state_by_step, number_steps
from ..operators.walks import count_walk_pairs, walk_to_rows
from ..settings import HOT_USER_DAY_ROWS, OD_HORIZON_SECONDS
from .layout import Slot, StoredTrajectory
from .network import Network


def trajectory(
    observations: DataFrame | StoredTrajectory,
    network: Network,
    order: int = 0,
    slot: Slot | None = None,
) -> DataFrame:
    """Deduplicated, located rows, restricted to cells with a ring if rings count.

    Ringless cells are taken out of the cell table, not looked up per row.
    """
    if isinstance(observations, StoredTrajectory):
        return observations.rows(order, slot)
    cells = network.ringed_cells() if order else network.cells
    placed = locate_observations(dedup_observations(observations), cells)
    return filter_time_slot(placed, *slot) if slot else placed


def matrix_from_pairs(counts: DataFrame, network: Network, order: int = 0) -> DataFrame:
    """Matrix (from_no, to_no, weight, prob) of counted pairs, spread over rings.

    Stored counts can serve several orders with one pass over the observations,
    as long as every cell has a ring.
    """
    weights = spread_pairs(counts, network.links(order)) if order else counts
    return row_normalize(weights)


def _by_user_day(
    observations: DataFrame,
    hot_rows: int | None,
    ordinary: Callable[[DataFrame], DataFrame],
    crowded: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Apply a pairing to raw observations, moving them once.

    Partitioned by user-day, copies can be removed and pairs formed in place.
    Hot user-days take the longer way: their copies collapse before they move,
    and then they are split by second.
    """
    rows = with_day(observations)
    hot = None if hot_rows is None else hot_user_days(observations, hot_rows)
    if hot is None:
        return ordinary(rows.repartition("user_id", "_day"))
    cold, busy = split_user_days(rows, hot)
    return ordinary(cold.repartition("user_id", "_day")).unionByName(crowded(busy))


def _in_place(
    stored: StoredTrajectory,
    order: int,
    ordinary: Callable[[DataFrame], DataFrame],
    crowded: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Apply a pairing to a stored trajectory: its ordinary rows do not move."""
    rows, busy = stored.parts(order)
    paired = ordinary(rows)
    return paired if busy is None else paired.unionByName(crowded(busy))


def slot_pairs(
    stored: StoredTrajectory, slots: list[Slot], order: int = 0
) -> DataFrame:
    """Counts (slot, from_no, to_no, weight) for several slots from one scan.

    ``slot`` is the place in the list. Pairs are formed among the rows of a slot only;
    a row that lies in two slots is counted in both.
    """
    unique = not stored.network.shared_coordinates
    keep = ["user_id", "_day", "ts", "slot", "cell_no"]
    lagged = _in_place(
        stored,
        order,
        lambda rows: lag_state_by_day(
            tag_slots(rows, slots).select(*keep), unique_times=unique, within=("slot",)
        ),
        lambda rows: lag_state_by_second(tag_slots(rows, slots).select(*keep), within=("slot",)),
    )
    return count_pairs(drop_incomplete(lagged), "prev_cell_no", "cell_no", within=("slot",))


def slot_matrices(
    stored: StoredTrajectory, slots: list[Slot], order: int = 0
) -> DataFrame:
    """Transition matrices (slot, from_no, to_no, weight, prob) of several slots at once."""
    counts = slot_pairs(stored, slots, order)
    if order:
        counts = spread_pairs(counts, stored.network.links(order), within=("slot",))
    return row_normalize(counts, within=("slot",))


def sequence(stored: StoredTrajectory) -> DataFrame:
    """Every user's observed rows in order, as (user_id, i, cell_no)."""
    numbered = _in_place(
        stored,
        0,
        lambda rows: number_steps(rows, stored.shifts).select("user_id", "i", "cell_no"),
        lambda rows: number_steps(rows, stored.shifts, crowded=True).select(
            "user_id", "i", "cell_no"
        ),
    )
    return numbered


def transition_pairs(
    observations: DataFrame | StoredTrajectory,
    network: Network,
    order: int = 0,
    slot: Slot | None = None,
    hot_rows: int | None = HOT_USER_DAY_ROWS,
) -> DataFrame:
    """Counts (from_no, to_no, weight) of consecutive same-day cells.

    A stored trajectory is read in place, and raw observations are not touched.
    """
    unique = not network.shared_coordinates
    if isinstance(observations, StoredTrajectory):
        if slot:
            return slot_pairs(observations, [slot], order).drop("slot")
        keep = ["user_id", "_day", "ts", "hour", "cell_no"]
        lagged = _in_place(
            observations,
            order,
            lambda rows: lag_state_by_day(rows.select(*keep), unique_times=unique),
            lambda rows: lag_state_by_second(rows.select(*keep)),
        )
        return count_pairs(drop_incomplete(lagged), "prev_cell_no", "cell_no")

    def place(rows: DataFrame) -> DataFrame:
        placed = trajectory(rows, network, order, slot)
        return placed.select("user_id", "_day", "ts", "hour", "cell_no")

    # Rows without a user or time could only ever precede each other.
    timed = observations.filter(F.col("user_id").isNotNull() & F.col("ts").isNotNull())
    lagged = _by_user_day(
        timed,
        hot_rows,
        lambda rows: lag_state_by_day(place(rows), unique_times=unique),
        lambda rows: lag_state_by_second(place(rows)),
    )
    return count_pairs(drop_incomplete(lagged), "prev_cell_no", "cell_no")


def transition_matrix(
    observations: DataFrame | StoredTrajectory,
    network: Network,
    order: int = 0,
    slot: Slot | None = None,
    hot_rows: int | None = HOT_USER_DAY_ROWS,
) -> DataFrame:
    """Transition matrix (from_no, to_no, weight, prob).

    ``order`` is the number of rings each observation is spread over; 0 takes
    the observed cell as certain. ``slot`` is (day from, day through, hour from,
    hour before). ``hot_rows`` of None skips the search for hot user-days.
    """
    return matrix_from_pairs(transition_pairs(observations, network, order, slot, hot_rows), network, order)


def od_matrix(
    observations: DataFrame | StoredTrajectory,
    network: Network,
    order: int = 0,
    horizon: int = OD_HORIZON_SECONDS,
    slot: Slot | None = None,
    hot_rows: int | None = HOT_USER_DAY_ROWS,
) -> DataFrame:
    """Origin-destination matrix (from_no, to_no, weight, prob)."""
    if isinstance(observations, StoredTrajectory):

        def kept(rows: DataFrame) -> DataFrame:
            rows = filter_time_slot(rows, *slot) if slot else rows
            return rows.select("user_id", "_day", "ts", "cell_no")

        found = _in_place(
            observations,
            order,
            lambda rows: od_destination(kept(rows), horizon=horizon),
            lambda rows: od_destination_by_second(kept(rows), horizon=horizon),
        )
        return matrix_from_pairs(count_pairs(found, "cell_no", "dest_cell_no"), network, order)

    def place(rows: DataFrame) -> DataFrame:
        placed = trajectory(rows, network, order, slot)
        return placed.select("user_id", "_day", "ts", "cell_no")

    trips = _by_user_day(
        observations,
        hot_rows,
        lambda rows: od_destination(place(rows), horizon=horizon),
        lambda rows: od_destination_by_second(place(rows), horizon=horizon),
    )
    return matrix_from_pairs(count_pairs(trips, "cell_no", "dest_cell_no"), network, order)


def transition_matrix_steps(rows: DataFrame, network: Network, order: int = 1) -> DataFrame:
    """Transition matrix of rows (user_id, i, cell_no), with ring noise.

    Steps in unknown or ringless cells vanish before pairing.
    """
    cells = network.ringed_cells() if order else network.cells
    known = Dimension(cells.df.select("cell_no"), cells.rows)
    kept = lookup_join(rows, known, ["cell_no"], "left_semi")
    lagged = drop_incomplete(lag_state_by_step(kept))
    return matrix_from_pairs(count_pairs(lagged, "prev_cell_no", "cell_no"), network, order)


def transition_matrix_walks(walks: DataFrame, network: Network, order: int = 1) -> DataFrame:
    """Transition matrix of walks (user_id, walk) over cells of the network, with ring noise.

    If every cell has a ring, neighbours in the list are the pairs and walks
    never move. Otherwise a vanished step makes its neighbours adjacent.
    """
    if order and network.ringed_cells().rows < network.cells.rows:
        return transition_matrix_steps(walk_to_rows(walks), network, order)
    return matrix_from_pairs(count_walk_pairs(walks), network, order)
