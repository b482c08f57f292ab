"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores.
``naive_1ring`` is the same matrix with every pair of states expanded before
summing, the way it is usually written. It is the yardstick, not a headline
query, and is not part of ``value``. Matrices read the stored trajectory, whose cost is
``store_trajectory``; ``transition_matrix_raw`` is one without it.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame  # noqa: E402

from checks import inputs  # noqa: E402
from checks.compare import local_session  # noqa: E402
from trackweave import operators as ops  # noqa: E402
from trackweave import plans  # noqa: E402
from trackweave.lineage import store  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
PROPAGATE_ROWS = 150
SLOTS = [(1, 5, 6, 12), (1, 5, 12, 18)]


def consume(df: DataFrame) -> None:
    """Compute every row and column, keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS)
    network = inputs.network(spark, SF_DIR)
    for order in (1, 2, 3):
        network.links(order)
    network.states(1)
    observations = inputs.observations(spark, SF_DIR)
    trajectories = []

    def stored():
        """The rows that the other queries read; the first call is the one that counts."""
        trajectories.append(plans.store_trajectory(observations, network))
        return trajectories[-1].rows()

    def rows():
        return trajectories[-1]

    stored()  # warm up
    matrix = store(plans.transition_matrix(rows(), network, 1))
    start = store(plans.starting_distribution(rows(), network, 1))

    def naive() -> DataFrame:
        states = ops.probabilistic_states(
            plans.trajectory(observations, network), network.states(1)
        )
        pairs = ops.drop_incomplete(ops.lag_state_by_day(states, state="states"))
        totals = ops.collect_pairs(ops.explode_updates(pairs, "prev_states", "states"))
        return ops.row_normalize(ops.simplify_matrix_ids(totals, network.cells))

    headline = {
        "store_trajectory": stored,
        "transition_matrix_raw": lambda: plans.transition_matrix(observations, network, 1),
        "transition_matrix_deterministic": lambda: plans.transition_matrix(rows(), network),
        "transition_matrix_1ring": lambda: plans.transition_matrix(rows(), network, 1),
        "transition_matrix_2ring": lambda: plans.transition_matrix(rows(), network, 2),
        "transition_matrix_3ring": lambda: plans.transition_matrix(rows(), network, 3),
        "od_matrix_1ring": lambda: plans.od_matrix(rows(), network, 1),
        "transition_matrix_slot": lambda: plans.transition_matrix(rows(), network, 1, SLOTS[0]),
        "slot_matrices": lambda: plans.slot_matrices(rows(), SLOTS, 1),
        "sequence_matrix": lambda: plans.transition_matrix_steps(plans.sequence(rows()), network),
        "propagate_150": lambda: ops.propagate(start, matrix, PROPAGATE_ROWS),
    }
    consume(headline["transition_matrix_1ring"]())  # warm up

    def timed(make) -> float:
        begin = time.perf_counter()
        consume(make())
        return round(time.perf_counter() - begin, 3)

    seconds = {name: timed(make) for name, make in headline.items()}
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "naive_1ring": timed(naive),
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
