"""Command line: list queries, run one, explain it, or write a report.

    python -m tidemark.cli list
    python -m tidemark.cli run reaction_ladder --data DIR [--rows 20] [--out PATH]
    python -m tidemark.cli explain reaction_ladder --data DIR
    python -m tidemark.cli report --data DIR --out report.md
    python -m tidemark.cli stats --data DIR

``stages`` prints the commands that stand for a stage or a report; each shows
its queries one after the other, and ``--out`` writes them as Parquet, a folder
for each, or as one Markdown file.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame

REPORT = ("items_per_day", "link_methods", "skip_reasons", "run_metrics", "round_trips", "calibration_deciles", "whitelist_bridge", "weekly_funnel")

#: Stages and reports, and the queries that each one runs.
STAGES = {
    "poll": ("overlapping_polls", "feed_items", "filing_entries", "news_articles", "archive_items"),
    "process": ("normalised_headlines", "content_hash_dups", "leader_clusters", "dedup_ratio"),
    "universe-sync": ("issuer_numbers", "universe_sync", "membership_changes", "ticker_numbers"),
    "resolve": ("resolve_items", "link_methods", "link_coverage"),
    "triage": ("unlinked_items",),
    "bars-record": ("snapshot_bars", "bar_universe"),
    "bars-backfill": ("backfill_plan", "window_coalesce", "aggregate_bars", "daily_upkeep", "exchange_candles"),
    "calendar-sync": ("calendar_rows", "calendar_counts", "earnings_slots"),
    "measure": ("reaction_abnormal", "reaction_summary", "recovery", "measure_two_clocks"),
    "documents": ("document_queue",),
    "interpret": ("interpretation_candidates", "prompt_contexts", "context_items", "judgment_checks"),
    "interpret-macro": ("coherence", "discovered_companies"),
    "decide": ("decide_gates", "sizing", "pending_intents"),
    "positions": ("account_state", "lots", "portfolio_cash"),
    "manage": ("position_manager", "exit_instants"),
    "backtest": ("backtest_decisions", "backtest_trades", "run_metrics"),
    "replay": ("replay_snapshots", "replay_comparison", "feature_overlay"),
    "replay-compare": ("compare_runs",),
    "eval-signals": ("eval_rows_join", "event_type_report", "calibration_deciles", "ece", "spearman_materiality", "speed_report", "neutral_report", "whitelist_bridge"),
    "eval-latency": ("latency_by_horizon", "latency_by_source"),
    "stats": ("items_per_day", "totals", "top_clusters", "link_coverage", "reaction_overview", "unmeasured_pairs", "calendar_ahead", "ingest_latency", "skip_reasons"),
}


def markdown(df: DataFrame, rows: int = 50) -> str:
    """A table of at most ``rows`` rows, in order of the columns."""
    got = df.orderBy(*df.columns).limit(rows).collect()
    line = lambda cells: "| " + " | ".join(str("" if c is None else c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(r) for r in got]])


def stage(spark, name: str, data: str, rows: int = 20, out: str | None = None) -> int:
    """Run the queries of a stage: shown, written as Parquet below ``out``, or as Markdown where that is an .md file."""
    from tidemark.plans import registry

    parts = []
    for query in STAGES[name]:
        df = registry.QUERIES[query](spark, data)
        if out is None or out.endswith(".md"):
            parts.append(f"## {query}\n\n{markdown(df, rows)}")
        else:
            df.write.mode("overwrite").parquet(f"{out.rstrip('/')}/{query}")
    if out is None:
        print("\n\n".join(parts))
    elif parts:
        with open(out, "w", encoding="utf-8") as f:
            f.write("\n\n".join(parts) + "\n")
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=["list", "stages", "run", "explain", "report", *STAGES])
    p.add_argument("name", nargs="?")
    p.add_argument("--data")
    p.add_argument("--rows", type=int, default=20)
    p.add_argument("--out")
    p.add_argument("--master")
    a = p.parse_args(argv)
    from tidemark.plans import registry

    if a.command == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    if a.command == "stages":
        print("\n".join(f"{k}: {', '.join(v)}" for k, v in STAGES.items()))
        return 0
    if not a.data or a.command in ("run", "explain") and a.name not in registry.QUERIES:
        p.error("a known query and --data are needed")
    from tidemark.session import session

    spark = session(a.master)
    if a.command == "report":
        text = "\n\n".join(f"## {n}\n\n{markdown(registry.QUERIES[n](spark, a.data))}" for n in REPORT)
        if a.out:
            with open(a.out, "w", encoding="utf-8") as f:
                f.write(text + "\n")
        else:
            print(text)
        return 0
    if a.command in STAGES:
        return stage(spark, a.command, a.data, a.rows, a.out)
    df = registry.QUERIES[a.name](spark, a.data)
    if a.command == "explain":
        df.explain("formatted")
    elif a.out:
        df.write.mode("overwrite").parquet(a.out)
    else:
        df.show(a.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
