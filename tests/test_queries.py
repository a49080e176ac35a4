"""The registered queries against their SQL on the smallest tables, and the catalog's own rules."""

import importlib.util
import os

import duckdb
import pytest

FOLDER = "/root/testdata/sf0.001"
SMALL = ["s1_read_bars", "s3_read_disclosures", "s6_overlap_merge", "p1_input_contract", "p10_increasing_time", "f3_clause_split", "f7_market_clock",
         "f15_label_combinations", "j1_densify_grid", "j3_forward_session", "w5_forward_return", "w16_repeat_suppression", "w17_paired_trades",
         "a9_category_coverage", "a18_label_phi", "a26_quote_audit", "e1_study_panel", "e5_itemset_support", "e15_shifted_calendar", "r6_year_block_weights",
         "j5_latest_quote", "x4_excerpt_merge", "x7_review_agreement", "p8_annotation_validation", "c1_lag_horizon_map", "t4_resampled_bars",
         "k2_leg_selection", "l1_settlement", "l3_path_downside", "l5_leg_cash_flow", "l7_mark_scenario", "l8_outcome_grid", "j11_strategy_baseline", "c3_partial_correlation", "c4_fixed_effects",
         "c6_event_control_interactions", "t5_sliding_means", "t6_gap_sessions"]


def checker():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spec = importlib.util.spec_from_file_location("check", os.path.join(root, "tools", "check.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.mark.parametrize("name", SMALL)
def test_query_equals_sql(spark, name):
    from tidemark.plans import catalog
    tool = checker()
    con = duckdb.connect()
    for t in tool.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, FOLDER)
    cur = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert tool.rows_of(df.columns, [tuple(r) for r in df.collect()]) == tool.rows_of(names, cur.fetchall())


def test_entry_and_catalog(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 200
