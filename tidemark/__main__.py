"""python -m tidemark [--dir D] [--out O] [--config C] [--no-gates] STAGE|QUERY...: run and write named queries.

A stage is a list of queries.  The run fails (exit 1) where the coverage of signals, the share of
sections found or of scores that are valid stays below its gate in the settings, or a sanity check
does not pass.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.config import load_config
from tidemark.plans import core
from tidemark.session import pin
from tidemark.sources.sinks import write_table

STAGES = {
    "index": ["index_quarters", "index_parse", "accession_from_filename"], "sample": ["deterministic_sample"], "sections": ["section_extract"], "check": ["section_report", "section_failures"],
    "universe": ["ticker_windows", "entity_resolution", "resolution_notes", "symbol_resolution", "map_review", "universe_filings"], "prices": ["symbol_vetting", "wide_to_long"],
    "returns": ["forward_returns", "lookahead_violations"], "coverage": ["coverage_panel", "coverage_by_year", "coverage_summary", "missing_companies"], "documents": ["document_scope"],
    "dictionary": ["lm_cohort_counts", "lm_shares"], "signals": ["prev_filing_asof", "lm_change", "signal_coverage", "missing_reasons"], "factors": ["factor_compound"],
    "backtest": ["backtest_panel", "long_short_monthly", "performance_summary", "factor_hac_1f", "factor_ols_hac"], "sanity": ["planted_sanity", "noise_sanity"], "llm-score": ["excerpt", "score_run", "scoring_report"], "llm-score-anonymized": ["memorization_cells"],
    "llm-signals": ["llm_change", "score_agreement"], "size": ["public_float", "asof_strict_size"], "robustness": ["variant_grid", "variant_verdicts", "long_short_value_weighted", "deflated_sharpe"],
    "anonymize": ["registrant_identities", "excerpt_audit", "entity_mask", "entity_mask_named", "planted_mask", "mask_report"], "memorization": ["memorization_cells", "bootstrap_ci"], "report": ["growth_path", "monthly_ic"],
}


#: The stages whose results are held against a gate of the settings, and the column that is.
GATES = {"signal_coverage": ("coverage", "signal_coverage"), "section_report": ("coverage", "sections"), "scoring_report": ("valid_share", "scores")}


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("names", nargs="+")
    p.add_argument("--dir", default="/root/testdata/sf0.01")
    p.add_argument("--out", default="artifacts")
    p.add_argument("--config")
    p.add_argument("--no-gates", action="store_true")
    a = p.parse_args(args)
    gates = load_config(a.config)["gates"]
    spark, queries, failed = pin(SparkSession.builder.getOrCreate()), core().queries, 0
    for name in [q for n in a.names for q in STAGES.get(n, [n])]:
        path = f"{a.out}/{name}"
        write_table(queries[name](spark, a.dir), path)
        done = spark.read.parquet(path)
        print(f"{name}: {done.count()} rows in {path}")
        column, gate = GATES.get(name, (None, None))
        if column and not a.no_gates and (done.agg(F.min(column)).first()[0] or 0) < gates[gate]:
            print(f"{name}: {column} below {gates[gate]}")
            failed = 1
        elif not a.no_gates and name.endswith("_sanity") and not done.where("NOT passed").isEmpty():
            print(f"{name}: not passed")
            failed = 1
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
