"""Registered queries against their SQL on the smallest data (all of them with ALL_QUERIES=1)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import check

FOLDER = "/root/testdata/sf0.001"
FEW = ["v01_value_proxy", "v06_equal_mob_default", "v08_roll_rate", "v12_concentration", "v15_channel_economics", "v18_customer_frame",
       "sg07_method_scorecard", "ew02_forward_label", "ew06_feature_matrix", "ew14_threshold_table", "ew15_watchlist", "ew21_deterioration_lead",
       "m16_decile_table", "m18_by_population", "pl04_scenario_table", "pl07_cutoff_sensitivity", "q03_data_quality", "w19_dpd_walk", "w20_sticky_default_and_stop",
       "s02_s06_csv_round_trip", "f09_amortisation", "a03_exact_quantiles", "w12_decile_by_rank", "m02_tree_splits", "m10_logistic_of_two", "m12_grouped_folds",
       "m19_replicate_auc", "q12_fingerprint", "q12_stored_run"]
NAMES = list(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else FEW


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    text, good = check.compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql()[name])
    assert good, text


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 15
