"""Quality rules with host verdicts.

Every document is measured and held against rules of its own. The failures are
added up per host (the ``source`` column), each host's failure rate is shrunk
with a beta prior fitted to the rates of all hosts by the method of moments, and
the verdict on the host is joined back to its documents: small hosts are judged
close to the average, large ones by their own record.

A document is kept if it fails no rule and its host is trusted: a host is not if
its shrunk rate is above ``HOST_LIMIT`` by ``DEVIATIONS`` standard deviations of
the beta distribution, so that a few bad documents do not cost a small host its
clean ones. The rules ``short`` and
``repeats`` are the base: failing one of them always rejects.

The measured rows are stored once; host sums and verdicts read that table. Host
sums combine before the shuffle, so a host with a third of all rows costs one
row per task, and the join back is one that Spark can split.

Edge cases: a null or empty text has no words, so it is short and rejected. A
null host is no host: such documents are judged by their own rules alone. An
empty table gives an empty result. Repeated rows count and come back as often
as they came. Input columns are never overwritten: the result is one struct
column with a free name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import store
from .columns import WHITE, carries_other_columns, free_name, neighbours, white_words, without

MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
MAX_SYMBOL_PERCENT = 10
MAX_DUPLICATE_LINE_PERCENT = 30
MAX_UPPER_PERCENT = 40
WORD_CHARACTERS = (2, 15)
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HOST_LIMIT = 0.5
DEVIATIONS = 2
RULES = ("short", "repeats", "symbols", "duplicate_lines", "upper", "word_length")


def _covered(windows: Column, width: int) -> Column:
    """Words inside windows that occur twice or more; ``windows`` has their hashes."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twins = neighbours(placed, 1, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    places = F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda t: t.isNotNull()))))
    gaps = neighbours(places, 1, lambda a, b: F.least(b - a, F.lit(width)))
    return F.aggregate(gaps, F.lit(width), lambda total, gap: total + gap)


def measured(documents: DataFrame) -> DataFrame:
    """documents with doc measures; needs a column ``text`` and leaves it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    steps = documents.withColumn("_words", white_words(F.col("text")))
    steps = steps.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):  # two, four, eight words
        steps = steps.withColumn("_hashes", neighbours(F.col("_hashes"), step, lambda a, b: F.xxhash64(a, b)))
    steps = steps.withColumn("_kinds", F.size(F.array_distinct("_hashes")))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    steps = steps.withColumn("_lines", lines)
    repeated = F.when(F.col("_kinds") < F.size("_hashes"), _covered(F.col("_hashes"), REPEAT_WINDOW))
    return steps.select(
        *documents.columns,
        F.struct(
            F.size("_words").cast("long").alias("n_words"),
            F.length(without(text, WHITE)).cast("long").alias("word_chars"),
            (F.length(text) - F.length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.coalesce(repeated, F.lit(0)).cast("long").alias("n_repeat_words"),
            F.size("_lines").cast("long").alias("n_lines"),
            (F.length(text) - F.length(without(text, UPPER))).cast("long").alias("n_upper"),
        ).alias("_measures"),
    )


def failures(m: Column) -> dict[str, Column]:
    """Which rules the measures fail."""
    low, high = WORD_CHARACTERS
    return {
        "short": m["n_words"] < MIN_WORDS,
        "repeats": 100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"],
        "symbols": 100 * m["n_symbols"] > MAX_SYMBOL_PERCENT * m["word_chars"],
        "duplicate_lines": 100 * m["n_dup_lines"] > MAX_DUPLICATE_LINE_PERCENT * m["n_lines"],
        "upper": 100 * m["n_upper"] > MAX_UPPER_PERCENT * m["word_chars"],
        "word_length": (m["word_chars"] < low * m["n_words"]) | (m["word_chars"] > high * m["n_words"]),
    }


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Parameters of the prior, from the failure rates of all hosts (one row is collected)."""
    rate = F.col("failed") / F.col("n")
    m, v = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    if m is None:
        return 1.0, 1.0
    # Equal rates everywhere: the prior is as firm as a million documents.
    weight = min(m * (1 - m) / v - 1, 1e6) if v and v < m * (1 - m) else (1e6 if not v else 1e-3)
    return m * weight, (1 - m) * weight


def quality_verdicts(documents: DataFrame, keep: list[str], name: str = "quality") -> DataFrame:
    """Columns ``keep`` of documents and a struct ``name``: the measures, base_failed,
    n_failed, host_rate, kept."""
    inputs = documents.select(*dict.fromkeys([*keep, "source", "text"]))
    table = measured(inputs).select(
        *keep, F.col("source").alias(free_name(keep, "_host")), F.col("_measures").alias(free_name(keep, name))
    )
    host, name = table.columns[-2:]
    table = store(table)
    failed = failures(F.col(name))
    n_failed = sum((F.coalesce(f, F.lit(False)).cast("long") for f in failed.values()), F.lit(0))
    hosts = store(
        table.filter(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("_h"))
        .agg(F.count("*").alias("n"), F.sum((n_failed > 0).cast("long")).alias("failed"))
    )
    alpha, beta = beta_prior(hosts)
    seen = F.col("n") + alpha + beta
    rates = hosts.select("_h", ((F.col("failed") + alpha) / seen).alias("_rate"), seen.alias("_seen"))
    joined = table.join(rates, F.col(host) == F.col("_h"), "left")
    base = failed["short"] | failed["repeats"]
    doubt = F.sqrt(F.col("_rate") * (1 - F.col("_rate")) / (F.col("_seen") + 1))
    trusted = F.coalesce(F.col("_rate") - DEVIATIONS * doubt <= HOST_LIMIT, F.lit(True))
    verdict = F.struct(
        F.col(f"{name}.*"),
        base.alias("base_failed"),
        n_failed.alias("n_failed"),
        F.round(F.col("_rate"), 4).alias("host_rate"),
        ((n_failed == 0) & trusted).alias("kept"),
    )
    return joined.select(*keep, verdict.alias(name))


@carries_other_columns("source", "text")
def keep_good(documents: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns as they came."""
    judged = quality_verdicts(documents, documents.columns)
    return judged.filter(F.col(judged.columns[-1])["kept"]).select(*documents.columns)
