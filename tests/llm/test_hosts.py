"""Host verdicts: one bad host among many, and small ones."""

from collections import defaultdict

from trackweave.llm.quality_rules import beta_prior, keep_good, quality_verdicts

PROSE = " ".join(f"word{i}" for i in range(40))
SYMBOLS = "%%%%%% " * 40


def rows():
    """Thirty good hosts, one of which most documents fail, two small ones, and no host."""
    number = iter(range(10_000))
    for host in range(30):
        yield from ((next(number), SYMBOLS if i < 2 else PROSE, f"good{host}") for i in range(40))
    yield from ((next(number), SYMBOLS if i % 10 else PROSE, "bad") for i in range(100))
    yield from ((next(number), text, "small") for text in (SYMBOLS, SYMBOLS, PROSE))
    yield (next(number), SYMBOLS, "single")
    yield (next(number), PROSE, None)


def test_a_bad_host_loses_its_clean_documents_and_small_ones_do_not(spark):
    table = spark.createDataFrame(list(rows()), "doc_id long, text string, source string")
    clean, kept = defaultdict(int), defaultdict(int)
    for row in quality_verdicts(table, ["doc_id", "source"]).collect():
        clean[row.source] += row.quality.n_failed == 0
        kept[row.source] += row.quality.kept
    assert clean["bad"] == 10 and kept["bad"] == 0
    assert kept["small"] == clean["small"] == 1 and kept["single"] == 0 and kept[None] == 1
    assert all(kept[f"good{h}"] == clean[f"good{h}"] == 38 for h in range(30))
    assert keep_good(table).count() == 30 * 38 + 2


def test_shrunk_rates_lie_between_the_host_and_the_prior(spark):
    table = spark.createDataFrame(list(rows()), "doc_id long, text string, source string")
    shown = {r.source: r.quality.host_rate for r in quality_verdicts(table, ["source"]).collect()}
    hosts = [*([(40, 2)] * 30), (100, 90), (3, 2), (1, 1)]
    alpha, beta = beta_prior(spark.createDataFrame(hosts, "n long, failed long"))
    prior = alpha / (alpha + beta)
    assert prior < shown["small"] < 2 / 3 and prior < shown["single"] < 1 and shown[None] is None
    assert abs(shown["bad"] - (90 + alpha) / (100 + alpha + beta)) < 1e-4
