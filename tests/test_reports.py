from __future__ import annotations

import json

import pytest

from tidemark.plans import core, reports
from tidemark.sources import sinks


def test_bars_and_readings():
    good = {"mean_ic": 0.03, "ic_t": 2.5, "sharpe_net": 0.9}
    assert reports.bars_cleared(good, 3.0, 0.99) == ["IC", "Sharpe after costs", "factor alpha", "deflated Sharpe"]
    assert reports.bars_cleared({**good, "ic_t": None}, float("nan"), 0.95) == ["Sharpe after costs"] and reports.bars_cleared({}, 1.0, 0.1) == []
    assert reports.memorization_reading([0.1, None, -1.9], 1, 2) == "no_performance"
    assert reports.memorization_reading([0.1, 2.2], 0.1, 2) == "memorized" and reports.memorization_reading([-3.0], -0.1, 2) == "reads_the_text"


def test_reports_name_known_queries_and_are_written(spark):
    known = core().queries
    assert {q for parts in reports.REPORTS.values() for _, q in parts} <= set(known)
    small = {q: lambda s, d: spark.createDataFrame([("a", 0.5, None), ("b", 1.0, 2)], "k string, x double, n int") for q in known}
    text = reports.report(spark, "", "coverage", small, max_rows=1)
    assert text.startswith("# Coverage") and "| a | 0.5000 | – |" in text and "Only the first 1 rows" in text
    assert json.loads(reports.report_json(spark, "", "coverage", small))["Coverage by year"][1] == {"k": "b", "n": 2, "x": 1.0}
    with pytest.raises(ValueError, match="more than 1"):
        sinks.nested_json({"x": small["coverage_summary"](spark, "")}, max_rows=1)


def test_results_are_read_back(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "one"))
    assert reports.load_reports(spark, str(tmp_path), ["one"])["one"].count() == 3
    with pytest.raises(Exception, match="two"):
        reports.load_reports(spark, str(tmp_path), ["two"])
