"""Random walks drawn from a matrix, and statistics over them.

Walks are drawn for all users at once. A draw looks up the interval of the
origin's cumulative probabilities that holds the user's random number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import uniform
from ..lineage import cut_lineage, store
from ..settings import WALK_STEPS_PER_CHECKPOINT
from .dimensions import Dimension, lookup_join, measure
from .matrix import count_pairs

# Slots of the smallest origin: they also spread a crowded origin over tasks.
MIN_SLOTS = 64


def transition_cdf(matrix: DataFrame) -> DataFrame:
    """Cumulative probability per origin, by destination: (lo, hi].

    Rounded to 12 decimals so that summation order does not matter; the last
    interval is open above, so that every random number finds a destination.
    """
    row = Window.partitionBy("from_no").orderBy("to_no")
    total = F.sum("prob").over(row.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = matrix.select("from_no", "to_no", F.round(total, 12).alias("cum"))
    last = F.lead("cum").over(row).isNull()
    return summed.select(
        "from_no",
        "to_no",
        "cum",
        F.coalesce(F.lag("cum").over(row), F.lit(0.0)).alias("lo"),
        F.when(last, F.lit(float("inf"))).otherwise(F.col("cum")).alias("hi"),
    )


def _slot(number: Column, slots: Column) -> Column:
    return F.floor(number * slots).cast("int")


def draw_table(cdf: DataFrame) -> DataFrame:
    """Index the intervals by equal slots of (0, 1), at least one per interval.

    A random number names one slot of its origin and then meets about two
    intervals on average, not the whole row of the matrix. ``to_slots`` is the
    number of slots of the destination, which the next draw needs.
    """
    slots = cdf.groupBy("from_no").agg(
        F.greatest(F.count("*"), F.lit(MIN_SLOTS)).cast("int").alias("slots")
    )
    after = slots.select(F.col("from_no").alias("to_no"), F.col("slots").alias("to_slots"))
    last = F.col("slots") - 1
    begin = F.least(_slot(F.col("lo"), F.col("slots")), last)
    end = F.least(_slot(F.least("hi", F.lit(1.0)), F.col("slots")), last)
    return (
        cdf.join(slots, "from_no")
        .join(after, "to_no", "left")
        .select(
            "from_no",
            F.col("slots").alias("from_slots"),
            F.explode(F.sequence(begin, end)).alias("slot"),
            "lo",
            "hi",
            "to_no",
            "to_slots",
        )
    )


def _origins(table: Dimension) -> Dimension:
    """(cell_no, slots) of every origin."""
    first = table.df.filter((F.col("slot") == 0) & (F.col("lo") == 0))
    return measure(
        first.select(F.col("from_no").alias("cell_no"), F.col("from_slots").alias("slots")).distinct()
    )


def _draw(walkers: DataFrame, table: Dimension, number: Column) -> DataFrame:
    """Add (to_no, to_slots) to walkers with (cell_no, slots); null where stuck."""
    hit = F.expr(
        "cell_no = from_no AND CAST(floor(_r * slots) AS INT) = slot AND _r > lo AND _r <= hi"
    )
    return walkers.withColumn("_r", number).join(table.joinable(), hit, "left")


def next_state_draw(
    walkers: DataFrame, cdf: DataFrame, step: int = 1, seed: int = 0
) -> DataFrame:
    """One draw for (user_id, cell_no): adds ``next_no``, null where nothing leads on."""
    table = measure(store(draw_table(cdf)))
    placed = lookup_join(walkers, _origins(table), ["cell_no"], "left")
    number = uniform("user_id", step, seed=seed)
    return _draw(placed, table, number).select(
        "user_id", "cell_no", F.col("to_no").alias("next_no")
    )


def synthesize_walks(
    starts: DataFrame,
    matrix: DataFrame,
    steps: int,
    seed: int = 0,
    every: int = WALK_STEPS_PER_CHECKPOINT,
) -> DataFrame:
    """Walks (user_id, walk) of the start cell and up to ``steps`` moves.

    A walker in a cell without outgoing moves stops there.
    """
    table = measure(store(draw_table(transition_cdf(matrix))))
    walkers = lookup_join(starts.select("user_id", "cell_no"), _origins(table), ["cell_no"], "left")
    walkers = walkers.withColumn("walk", F.array("cell_no"))
    for step in range(1, steps + 1):
        number = uniform("user_id", step, seed=seed)
        walkers = _draw(walkers, table, number).selectExpr(
            "user_id",
            "to_no AS cell_no",
            "to_slots AS slots",
            "if(to_no IS NULL, walk, array_append(walk, to_no)) AS walk",
        )
        if step % every == 0 and step < steps:
            walkers = cut_lineage(walkers)
    return walkers.select("user_id", "walk")


def walk_to_rows(walks: DataFrame) -> DataFrame:
    """One row (user_id, i, cell_no) per step, numbered from 1."""
    return walks.select("user_id", F.posexplode("walk").alias("i", "cell_no")).withColumn(
        "i", F.col("i") + 1
    )


def random_states(users: DataFrame, n: int, cells: int, seed: int = 0) -> DataFrame:
    """``n`` uniformly drawn cells per user as (user_id, i, cell_no)."""
    drawn = F.floor(uniform("user_id", "i", seed=seed) * cells) + 1
    return users.select("user_id", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i")).select(
        "user_id", "i", drawn.cast("int").alias("cell_no")
    )


def add_ring_noise(
    rows: DataFrame, cells: DataFrame | Dimension, states: DataFrame | Dimension
) -> DataFrame:
    """Attach the ring state of every step; unknown cells and ringless ones vanish."""
    cells = measure(cells)
    ids = Dimension(cells.df.select("cell_no", "cell_id"), cells.rows)
    placed = lookup_join(rows, ids, ["cell_no"])
    return lookup_join(placed, states, ["cell_id"]).select("user_id", "i", "cell_no", "states")


def walk_vectors(noisy: DataFrame, *carried: str) -> DataFrame:
    """The noisy steps as rows (user_id, i, cell_id, prop), after ``carried`` columns."""
    return noisy.select(*carried, "user_id", "i", F.inline("states"))


def count_walk_pairs(walks: DataFrame) -> DataFrame:
    """Counts of consecutive cells of (user_id, walk), without a shuffle by user."""
    steps = F.transform(
        F.sequence(F.lit(1), F.size("walk") - 1),
        lambda k: F.struct(
            F.get("walk", k - 1).alias("prev_cell_no"), F.get("walk", k).alias("cell_no")
        ),
    )
    pairs = walks.filter(F.size("walk") > 1).select(F.inline(steps))
    return count_pairs(pairs, "prev_cell_no", "cell_no")


def step_mean(rows: DataFrame, links: DataFrame | Dimension) -> DataFrame:
    """Mean state over the walkers of each step as (i, cell_no, p).

    Walkers are counted per step and cell before their states are spread. Those in a
    cell without links have no state and do not count.
    """
    links = measure(links)
    linked = Dimension(links.df.select("cell_no").distinct(), links.rows)
    counts = rows.groupBy("i", "cell_no").agg(F.count("*").alias("_n"))
    known = lookup_join(counts, linked, ["cell_no"], "left_semi")
    share = F.col("_n") / F.sum("_n").over(Window.partitionBy("i"))
    spread = lookup_join(known.withColumn("_share", share), links, ["cell_no"])
    return spread.groupBy("i", F.col("link_no").alias("cell_no")).agg(
        F.sum(F.col("_share") * F.col("prop")).alias("p")
    )


def running_sums(means: DataFrame, last_step: int) -> DataFrame:
    """Sums of the step means as intervals (cell_no, begin, until, total).

    A cell missing at a step counts as 0, so its sum stays from one of its steps to
    the next: a row per step and cell of ``means``, however long the steps between.
    """
    cell = Window.partitionBy("cell_no").orderBy("i")
    so_far = cell.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return means.select(
        "cell_no",
        F.col("i").alias("begin"),
        F.coalesce(F.lead("i").over(cell) - 1, F.lit(last_step)).alias("until"),
        F.sum("p").over(so_far).alias("total"),
    )


def running_mean(means: DataFrame, last_step: int) -> DataFrame:
    """Mean of the step means 1..i for every step i, where it is not zero."""
    steps = F.explode(F.sequence("begin", "until")).alias("i")
    return running_sums(means, last_step).select("cell_no", "total", steps).select(
        "i", "cell_no", (F.col("total") / F.col("i")).alias("p")
    )


def running_mean_at(means: DataFrame, step: int) -> DataFrame:
    """The running mean (cell_no, p) at one step, read from the intervals."""
    return running_sums(means.filter(F.col("i") <= step), step).filter(
        F.col("until") == step
    ).select("cell_no", (F.col("total") / step).alias("p"))


def last_step_distribution(means: DataFrame, last_step: int) -> DataFrame:
    """The distribution (cell_no, p) at the last step."""
    return means.filter(F.col("i") == last_step).select("cell_no", "p")
