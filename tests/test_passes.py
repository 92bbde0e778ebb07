"""How often queries read the large tables, and that sharing a pass changes no result."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import gates, panel, warning
from ledgerscope.plans import catalog, pipeline
from ledgerscope.sources import views

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["v20_conservation_checks", "q09_verdict", "q01_all_checks", "m05_mixed_clusters", "sg06_cluster_profile"])
def test_the_panel_is_measured_once_and_walked_once(spark, tmp_path, monkeypatch, name):
    log, plain = str(tmp_path / "rows"), views.Book.table

    def counted(batches):
        for b in batches:
            with open(log, "a") as f:
                f.write(f"{len(b)}\n")
            yield b

    def table(book, t):
        df = plain(book, t)
        return df.mapInPandas(counted, df.schema) if t == "lineitem" else df

    monkeypatch.setattr(views.Book, "table", table)
    catalog.QUERIES[name](spark, FOLDER).collect()
    read = sum(map(int, open(log).read().split()))
    assert os.path.exists(log) and read <= 2 * spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()


def test_signals_of_a_user_are_not_repeated_per_customer_before_the_windows(spark, monkeypatch):
    seen, plain = [], warning.behaviour_features
    monkeypatch.setattr(warning, "behaviour_features", lambda b, *key: seen.append(b.count()) or plain(b, *key))
    b = pipeline.Pipeline(spark, FOLDER)
    shared = b.matrix
    assert seen[0] < b.behaviour.count()
    each = warning.feature_matrix(b.outcome_months.filter(F.col("label") != -1), b.behaviour)
    assert shared.exceptAll(each).count() == 0 and each.exceptAll(shared).count() == 0


def test_months_are_summed_per_loan_before_a_loan_is_dealt_to_both_splits(spark):
    rows = [(1, m, int(m == 9), "train", "train" if m < 5 else "test") for m in range(1, 11)] + [(2, 3, 0, "test", "train")]
    df = spark.createDataFrame(rows, "loan_id long, obs_month int, label int, split_within string, split_oot string")
    audit = warning.split_audit(df)
    got = {(r["split"], r["part"]): (r["n_rows"], r["n_loans"], r["n_pos"], r["first_month"], r["last_month"]) for r in audit.collect()}
    assert got == {("within", "train"): (10, 1, 1, 1, 10), ("within", "test"): (1, 1, 0, 3, 3), ("oot", "train"): (5, 2, 0, 1, 4), ("oot", "test"): (6, 1, 1, 5, 10)}
    plan = audit._jdf.queryExecution().optimizedPlan().toString().splitlines()
    explode = next(i for i, line in enumerate(plan) if "Generate explode" in line)
    assert any("Aggregate" in line for line in plan[explode:])


def test_keys_are_counted_only_where_a_bucket_is_large(spark, monkeypatch):
    grouped, plain = [], type(spark.range(1)).groupBy
    df = spark.createDataFrame([(k, i) for k in range(5) for i in range(k + 1)], "k long, i long")
    monkeypatch.setattr(type(df), "groupBy", lambda d, *keys: grouped.append(list(map(str, keys))) or plain(d, *keys))
    one = panel.sequence_number(df, "k", ["i"], "n", 100)
    assert ["k"] not in grouped and one.schema["n"].metadata[panel.LONGEST] >= 5
    monkeypatch.setattr(panel, "BUCKETS", 1)  # all keys in one bucket of 15 rows, none above the limit
    two = panel.sequence_number(df, "k", ["i"], "n", 10)
    assert ["k"] in grouped and two.schema["n"].metadata[panel.LONGEST] == 5
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


@pytest.mark.parametrize("chunk", [2, 100])
def test_facts_of_a_loan_are_those_of_the_single_checks(spark, monkeypatch, chunk):
    monkeypatch.setattr(panel, "CHUNK", chunk)
    rows = [(1, 1, 0), (1, 2, 30), (1, 3, 0), (2, 1, 60), (2, 2, 90), (2, 3, 120), (2, 4, 180), (2, 5, 200), (3, 1, 0), (3, 3, 0), (4, 2, 30), (4, 2, 30), (None, 1, 0)]
    df = spark.createDataFrame([(k, p, d, 4 + p, int(d == 0), p) for k, p, d in rows],
                               "loan_id long, period_index long, dpd int, obs_month int, prepayment_flag int, missed_payments_cum long")
    df = df.withMetadata("period_index", {panel.LONGEST: 5})
    facts = {r["loan_id"]: r.asDict() for r in gates.loan_facts(df).collect()}
    assert set(facts) == {1, 2, 3, 4, None}
    for one in (gates.contiguity(df), gates.cured_loans(df), warning.loan_events(df), warning.default_month(df)):
        for r in one.collect():
            assert {k: facts[r["loan_id"]][k] for k in r.asDict()} == r.asDict()
    assert [facts[k]["n_rows"] - facts[k]["n_distinct"] for k in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert (facts[2]["w"], facts[2]["L"], facts[2]["n_early"], facts[2]["n_early_late"]) == (4, 5, 3, 3)
