"""Written reports: small results of the named queries put into Markdown and JSON."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from tidemark.config import DEFAULTS
from tidemark.sources.sinks import markdown_table, nested_json

#: The parts of each report: heading and the query whose result stands under it.
REPORTS: dict[str, Sequence[tuple[str, str]]] = {
    "coverage": [("Coverage by period", "coverage_summary"), ("Coverage by year", "coverage_by_year")],
    "backtest": [("Performance", "performance_summary"), ("Quantiles", "long_short_monthly"), ("One factor", "factor_hac_1f"), ("Sanity", "planted_sanity"), ("Noise", "noise_sanity")],
    "robustness": [("Variants", "variant_grid"), ("Readings", "variant_verdicts"), ("Deflated Sharpe ratios", "deflated_sharpe")],
    "memorization": [("Cells", "memorization_cells"), ("Intervals", "bootstrap_ci")],
}


def bars_cleared(summary: Mapping[str, float], alpha_t: float, dsr: float, bars: Mapping[str, float] | None = None) -> list[str]:
    """Which bars a result clears: the correlation with its t, the net Sharpe ratio, the t of its alpha,
    and the deflated ratio; a figure that is missing clears none."""
    b = DEFAULTS["bars"] if bars is None else bars
    over = lambda x, bar: x is not None and x == x and x > bar
    checks = {
        "IC": over(summary.get("mean_ic"), b["ic"]) and over(summary.get("ic_t"), b["ic_t"]), "Sharpe after costs": over(summary.get("sharpe_net"), b["sharpe_net"]),
        "factor alpha": over(alpha_t, b["alpha_t"]), "deflated Sharpe": over(dsr, b["dsr"]),
    }
    return [name for name, ok in checks.items() if ok]


def memorization_reading(cell_ts: Sequence[float | None], low: float, high: float) -> str:
    """``no_performance`` where no cell differs from zero, ``memorized`` where the original text wins before
    the cutoff but not after (the interval of the difference lies above zero), else ``reads_the_text``."""
    if all(t is None or abs(t) < 2 for t in cell_ts):
        return "no_performance"
    return "memorized" if low > 0 else "reads_the_text"


def report(spark: SparkSession, sf_dir: str, name: str, queries: Mapping[str, Callable[[SparkSession, str], DataFrame]], max_rows: int = 200) -> str:
    """A report as Markdown; of a result longer than ``max_rows`` only the first rows are shown, with a note."""
    parts = [f"# {name.capitalize()}"]
    for heading, query in REPORTS[name]:
        df = queries[query](spark, sf_dir)
        parts += [f"## {heading}", markdown_table(df, max_rows=max_rows)]
    return "\n\n".join(parts)


def report_json(spark: SparkSession, sf_dir: str, name: str, queries: Mapping[str, Callable[[SparkSession, str], DataFrame]]) -> str:
    """The same as one JSON document: a list of rows under every heading."""
    return nested_json({heading: queries[query](spark, sf_dir) for heading, query in REPORTS[name]})


def load_reports(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """The written results that a report reads, by name; a missing one is an error that names it."""
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
