"""One query per operator, over whole tables.

Times come out as microseconds, probabilities rounded to nine decimals and lists
as rows or text, so that two engines can be compared value by value.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave import operators as ops
from trackweave import plans, sources
from trackweave.functions import outer_product, sort_states, zip_states
from trackweave.lineage import session_folder
from trackweave.settings import HOT_USER_DAY_ROWS

from . import inputs

Query = Callable[[SparkSession, str], DataFrame]

SLOT_1 = (1, 5, 6, 12)
SLOT_2 = (1, 5, 12, 18)
# The lengths of the propagations.
PROPAGATE_ROWS = 150
PHASE_ROWS = (150, 50)
# Steps of the propagation in its form for long vectors.
SHUFFLED_ROWS = 12
# Steps of the drawn walks.
WALK_STEPS = 6
RANDOM_STEPS = 12

REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    # A trailing underscore keeps a query apart from an imported function.
    REGISTRY[function.__name__.rstrip("_")] = function
    return function


# --- shared pieces ---------------------------------------------------------


def _round(column: str | Column) -> Column:
    """Nine decimals; exact halves are nudged up, as summation order could tip them."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column + F.lit(5e-12), 9)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: _round(c) for c in columns})


def _timed(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.unix_micros("ts")).withColumnRenamed("ts", "ts_us")


def _folder(spark: SparkSession) -> str:
    return os.path.join(session_folder(spark), f"check-{uuid.uuid4().hex}")


def _trajectory(spark: SparkSession, sf_dir: str, order: int = 0) -> DataFrame:
    return inputs.stored_trajectory(spark, sf_dir).rows(order)


def _states(spark: SparkSession, sf_dir: str, order: int) -> DataFrame:
    network = inputs.network(spark, sf_dir)
    return ops.probabilistic_states(_trajectory(spark, sf_dir), network.states(order))


def _state_pairs(spark: SparkSession, sf_dir: str, order: int) -> DataFrame:
    """Same-day pairs of ring states."""
    lagged = ops.lag_state_by_day(_trajectory(spark, sf_dir, order), state="cell_id")
    states = inputs.network(spark, sf_dir).states(order)
    return ops.pair_states(ops.drop_incomplete(lagged), states)


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.explode_updates(_state_pairs(spark, sf_dir, 1), "prev_states", "states")


def _counts_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same-day pairs of cell ids, counted."""
    lagged = ops.lag_state_by_day(_trajectory(spark, sf_dir, 1), state="cell_id")
    return ops.count_pairs(
        ops.drop_incomplete(lagged), "prev_cell_id", "cell_id", names=("from_cell", "to_cell")
    )


def _totals_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights between cell ids: pairs are counted, then spread over the rings of both ends."""
    distribution = inputs.network(spark, sf_dir).distribution(1)
    return ops.spread_pairs_by_id(_counts_by_id(spark, sf_dir), distribution)


def _matrix(spark: SparkSession, sf_dir: str, order: int = 0, slot=None, hot_rows=HOT_USER_DAY_ROWS) -> DataFrame:
    stored = inputs.stored_trajectory(spark, sf_dir, hot_rows)
    return plans.transition_matrix(stored, stored.network, order, slot)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.records_from_adjacency(inputs.adjacency(spark, sf_dir))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    counts = ops.ring_probability(ops.align_ring_counts(records))
    return ops.join_ring_parts(counts, ops.align_ring_members(records))


def _starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.start_cells(_trajectory(spark, sf_dir, 1))


def _start_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = inputs.stored_trajectory(spark, sf_dir)
    return plans.starting_distribution(stored, stored.network, 1)


def _walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.observed_walks(
        inputs.observations(spark, sf_dir), inputs.network(spark, sf_dir), WALK_STEPS
    )


def _sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's observed positions in order, as (user_id, i, cell_no)."""
    return plans.sequence(inputs.stored_trajectory(spark, sf_dir))


def _last_step(rows: DataFrame) -> int:
    return rows.agg(F.max("i")).first()[0]


def _both(spark: SparkSession, sf_dir: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The work over the observed sequences and over the drawn walks, told apart by ``drawn``."""
    observed = work(_sequence(spark, sf_dir))
    drawn = work(ops.walk_to_rows(_walks(spark, sf_dir)))
    return _told_apart(observed, drawn)


def _told_apart(observed: DataFrame, drawn: DataFrame) -> DataFrame:
    marked = [df.withColumn("drawn", F.lit(flag)) for df, flag in ((observed, False), (drawn, True))]
    return marked[0].unionByName(marked[1])


def _noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    network = inputs.network(spark, sf_dir)
    return _both(
        spark, sf_dir, lambda rows: ops.add_ring_noise(rows, network.cells, network.states(1))
    )


def _step_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    network = inputs.network(spark, sf_dir)
    return ops.step_mean(_sequence(spark, sf_dir), network.links(1))


def _state_rows(df: DataFrame, *keys: str) -> DataFrame:
    """One row per entry of a state."""
    return df.select(*keys, F.inline("states").alias("neighbor_id", "prop"))


def _texts(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, " ") for c in columns})


# --- sources and sinks -----------------------------------------------------


@query
def read_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    inputs.raw_observations(spark, sf_dir).write.csv(
        folder, sep=";", header=True, timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS"
    )
    read = sources.read_observations(spark, folder)
    return read.withColumn("ts_us", F.unix_micros("usage_dttm")).drop("usage_dttm")


@query
def read_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    inputs.raw_cells(spark, sf_dir).write.csv(folder, sep=";", header=True)
    return sources.read_cells(spark, folder)


@query
def read_ring_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ring files as they come, a folder per order; every file has its header line."""
    records = _records(spark, sf_dir)
    record = F.concat(
        F.concat_ws(" ", "cell_id", "n"), F.lit("\n"), F.array_join("members", " ")
    )
    # The number of a row is a multiple of 2^33 where its file begins.
    begins = F.monotonically_increasing_id() % (1 << 33) == 0
    header = F.when(begins, F.lit("0 0 header\n")).otherwise("")
    folders = []
    for order in ops.ORDERS:
        ring = records.filter(F.col("ring_order") == order).repartition(4, "cell_id")
        ordered = ring.sortWithinPartitions("cell_id").select(F.concat(header, record))
        folders.append(_folder(spark))
        ordered.write.text(folders[-1])
    return sources.read_ring_adjacency(spark, folders)


@query
def write_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    matrix = _matrix(spark, sf_dir)
    sources.write_matrix(matrix, folder)
    return _rounded(spark.read.csv(folder, schema=matrix.schema, header=True), "prob")


# --- projections, filters, dedup -------------------------------------------


@query
def normalize_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timed(ops.normalize_observations(inputs.raw_observations(spark, sf_dir)))


@query
def dedup_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timed(ops.dedup_observations(inputs.repeated_observations(spark, sf_dir)))


@query
def sort_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timed(ops.sort_observations(inputs.observations(spark, sf_dir)))


@query
def number_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = inputs.raw_cells(spark, sf_dir)
    return ops.number_cells(ops.normalize_cells(raw))


@query
def filter_time_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timed(ops.filter_time_slot(_trajectory(spark, sf_dir), *SLOT_1))


@query
def drop_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    lagged = ops.lag_state_by_day(_trajectory(spark, sf_dir))
    return _timed(ops.drop_incomplete(lagged))


# --- rings -------------------------------------------------------------------


@query
def align_ring_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.align_ring_counts(_records(spark, sf_dir))


@query
def ring_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ops.align_ring_counts(_records(spark, sf_dir))
    return _rounded(ops.ring_probability(counts), "prop_1", "prop_2", "prop_3")


@query
def align_ring_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = ops.align_ring_members(_records(spark, sf_dir))
    return _texts(aligned, "members_1", "members_2", "members_3")


@query
def join_ring_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _rounded(_parts(spark, sf_dir), "prop_1", "prop_2", "prop_3")
    return _texts(parts, "members_1", "members_2", "members_3")


@query
def ring_repeat_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = F.array(
        *[
            F.struct(F.lit(k).alias("ring_order"), F.col(f"props_{k}").alias("props"))
            for k in (1, 2, 3)
        ]
    )
    return (
        ops.ring_repeat_weights(_parts(spark, sf_dir))
        .select("cell_id", F.inline(rings))
        .select("cell_id", "ring_order", F.posexplode("props").alias("pos", "prop"))
        .withColumn("prop", _round("prop"))
    )


def _ring_states(order: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts = ops.ring_repeat_weights(_parts(spark, sf_dir))
        return _rounded(_state_rows(ops.ring_states(parts, order), "cell_id"), "prop")

    return run


for _order in (1, 2, 3):
    REGISTRY[f"ring_states_{_order}"] = _ring_states(_order)


@query
def zip_states_(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ops.ring_repeat_weights(_parts(spark, sf_dir))
    zipped = zip_states(F.col("members_1"), F.col("props_1"))
    return _rounded(_state_rows(parts.select("cell_id", zipped.alias("states")), "cell_id"), "prop")



# --- joins -------------------------------------------------------------------


@query
def locate_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = inputs.network(spark, sf_dir).cells
    return _timed(ops.locate_observations(inputs.observations(spark, sf_dir), cells))


@query
def probabilistic_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _state_rows(_timed(_states(spark, sf_dir, 2)), "user_id", "ts_us", "cell_no")
    return _rounded(rows, "prop")


@query
def simplify_matrix_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = _totals_by_id(spark, sf_dir)
    cells = inputs.network(spark, sf_dir).cells
    return _rounded(ops.simplify_matrix_ids(totals, cells), "weight")


@query
def gis_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = ops.count_pairs(
        ops.drop_incomplete(ops.lag_state_by_day(_trajectory(spark, sf_dir))),
        "prev_cell_no",
        "cell_no",
    )
    cells = inputs.network(spark, sf_dir).cells
    return _rounded(ops.gis_export(ops.row_normalize(counted), cells), "prob")


@query
def simplify_vector_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = ops.explode_states(ops.first_observation(_states(spark, sf_dir, 1)))
    cells = inputs.network(spark, sf_dir).cells
    placed = ops.simplify_vector_ids(first, cells)
    return placed.select("user_id", "cell_no", _round("prop").alias("prop"))


@query
def start_cell_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = ops.first_observation(_trajectory(spark, sf_dir)).select("user_id", "cell_id")
    cells = inputs.network(spark, sf_dir).cells
    return ops.simplify_vector_ids(first, cells).select("user_id", "cell_no")


@query
def add_ring_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_state_rows(_noisy(spark, sf_dir), "drawn", "user_id", "i", "cell_no"), "prop")


# --- states ------------------------------------------------------------------


@query
def deterministic_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    certain = ops.deterministic_states(_trajectory(spark, sf_dir))
    return _state_rows(_timed(certain), "user_id", "ts_us", "weekday", "hour")


@query
def outer_product_(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _timed(_state_pairs(spark, sf_dir, 1))
    product = F.inline(outer_product("prev_states", "states"))
    return _rounded(pairs.select("user_id", "ts_us", product), "weight")



@query
def explode_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_updates(spark, sf_dir), "weight")


@query
def explode_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_timed(ops.explode_states(_states(spark, sf_dir, 1))), "prop")


@query
def sort_states_(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ops.ring_repeat_weights(_parts(spark, sf_dir))
    ordered = ops.ring_states(parts, 2).withColumn("states", sort_states("states"))
    return ordered.select("cell_id", F.posexplode("states").alias("pos", "s")).select(
        "cell_id", "pos", F.col("s.cell_id").alias("neighbor_id"), _round("s.prop").alias("prop")
    )



@query
def walk_to_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.walk_to_rows(_walks(spark, sf_dir))


# --- aggregations ------------------------------------------------------------


@query
def collect_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_totals_by_id(spark, sf_dir), "weight")


@query
def initial_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_start_vector(spark, sf_dir), "p")


@query
def vector_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = ops.vector_collect(_start_vector(spark, sf_dir))
    billionths = F.transform("props", lambda p: F.round(p * 1e9).cast("long"))
    return _texts(packed.withColumn("props", billionths), "cells", "props")


@query
def step_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = inputs.network(spark, sf_dir).links(1)
    return _rounded(_both(spark, sf_dir, lambda rows: ops.step_mean(rows, links)), "p")


# --- windows -----------------------------------------------------------------


@query
def lag_state_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timed(ops.lag_state_by_day(_trajectory(spark, sf_dir)))


@query
def lag_state_by_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir, ops.lag_state_by_step)


@query
def number_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequence(spark, sf_dir)


@query
def od_destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timed(ops.od_destination(_trajectory(spark, sf_dir)))


@query
def row_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = _totals_by_id(spark, sf_dir)
    cells = inputs.network(spark, sf_dir).cells
    simple = ops.simplify_matrix_ids(totals, cells)
    return _rounded(ops.row_normalize(simple), "weight", "prob")


@query
def first_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timed(ops.first_observation(_trajectory(spark, sf_dir)))


@query
def arbitrary_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.start_cells(_trajectory(spark, sf_dir))


@query
def running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _last_step(_sequence(spark, sf_dir))
    return _rounded(ops.running_mean(_step_means(spark, sf_dir), last), "p")


# --- matrices ----------------------------------------------------------------


def _tm(order: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(_matrix(spark, sf_dir, order), "weight", "prob")

    return run


for _order, _name in enumerate(["deterministic", "1ring", "2ring", "3ring"]):
    REGISTRY[f"transition_matrix_{_name}"] = _tm(_order)


@query
def transition_matrix_gis(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = inputs.network(spark, sf_dir).cells
    return _rounded(ops.gis_export(_matrix(spark, sf_dir, 1), cells), "prob")


def _od(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = inputs.stored_trajectory(spark, sf_dir)
    return plans.od_matrix(stored, stored.network, 1)


@query
def od_matrix_by_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every user-day of two rows or more taken second by second."""
    stored = inputs.stored_trajectory(spark, sf_dir, 1)
    return _rounded(plans.od_matrix(stored, stored.network, 1), "weight", "prob")


@query
def transition_matrix_by_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_matrix(spark, sf_dir, 1, hot_rows=1), "weight", "prob")


@query
def transition_matrix_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From raw observations, without storing them first."""
    matrix = plans.transition_matrix(
        inputs.observations(spark, sf_dir), inputs.network(spark, sf_dir), 1
    )
    return _rounded(matrix, "weight", "prob")


@query
def slot_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrices of two slots from one scan."""
    stored = inputs.stored_trajectory(spark, sf_dir)
    return _rounded(plans.slot_matrices(stored, [SLOT_1, SLOT_2], 1), "weight", "prob")


@query
def od_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_od(spark, sf_dir), "weight", "prob")


@query
def od_matrix_gis(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = inputs.network(spark, sf_dir).cells
    return _rounded(ops.gis_export(_od(spark, sf_dir), cells), "prob")


@query
def transition_matrix_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_matrix(spark, sf_dir, 1, SLOT_1), "weight", "prob")


@query
def transition_matrix_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    network = inputs.network(spark, sf_dir)
    observed = plans.transition_matrix_steps(_sequence(spark, sf_dir), network)
    drawn = plans.transition_matrix_walks(_walks(spark, sf_dir), network)
    return _rounded(_told_apart(observed, drawn), "weight", "prob")


@query
def matrix_coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ops.matrix_coo(_matrix(spark, sf_dir, 1)), "prob")


# --- distributions -----------------------------------------------------------


@query
def to_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = ops.vector_collect(_start_vector(spark, sf_dir))
    return _rounded(ops.to_vector(packed), "p")


@query
def propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector, matrix = _start_vector(spark, sf_dir), _matrix(spark, sf_dir, 1)
    return _rounded(ops.propagate(vector, matrix, PROPAGATE_ROWS), "p")


@query
def propagate_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form for vectors that are too long to broadcast."""
    vector, matrix = _start_vector(spark, sf_dir), _matrix(spark, sf_dir, 1)
    steps = ops.propagate(vector, matrix, SHUFFLED_ROWS, broadcast_rows=0)
    return _rounded(steps, "p")


_chains: dict[tuple[str, str], DataFrame] = {}


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both phases, computed once per session; their steps are stored tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _chains:
        stored = inputs.stored_trajectory(spark, sf_dir)
        _chains[key] = plans.slot_phases(stored, stored.network, [SLOT_1, SLOT_2], list(PHASE_ROWS))
    return _chains[key]


@query
def chain_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_chain(spark, sf_dir), "p")


@query
def convergence_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector, matrix = _start_vector(spark, sf_dir), _matrix(spark, sf_dir, 1)
    return _rounded(ops.convergence_trace(vector, matrix, PROPAGATE_ROWS), "p", "change")


@query
def mobility_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        ops.mobility_trend(_chain(spark, sf_dir), PHASE_ROWS), "initial", "middle", "end"
    )


# --- walks -------------------------------------------------------------------


@query
def transition_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    cdf = ops.transition_cdf(_matrix(spark, sf_dir, 1))
    return _rounded(cdf.select("from_no", "to_no", "cum", "lo"), "cum", "lo")


@query
def next_state_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    cdf = ops.transition_cdf(_matrix(spark, sf_dir, 1))
    return ops.next_state_draw(_starts(spark, sf_dir), cdf)


@query
def synthesize_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(_walks(spark, sf_dir), "walk")


@query
def last_step_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _last_step(_sequence(spark, sf_dir))
    return _rounded(ops.running_mean_at(_step_means(spark, sf_dir), last), "p")


@query
def walk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ops.walk_vectors(_noisy(spark, sf_dir), "drawn"), "prop")


@query
def random_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = inputs.events(spark, sf_dir).select("user_id").distinct()
    cells = inputs.network(spark, sf_dir).cells
    return ops.random_states(users, RANDOM_STEPS, cells.rows)
