"""Ordered calculations against plain loops, with chunks small enough that every entity is cut."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import panel


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    sizes = {1: 1, 2: 3, 3: 4, 4: 9, 5: 40}  # entity 5 holds most of the table
    return [(k, i, rng.choice([-30, 0, 15, 30]), rng.choice([0, 0, 1])) for k, n in sizes.items() for i in range(1, n + 1)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k int, pos long, d int, flag int")


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def collect(df, *cols):
    return {(r["k"], r["pos"]): tuple(r[c] for c in cols) for r in df.collect()}


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_running(df, rows, size):
    got = collect(panel.running(df, "k", "pos", {
        "s": ("sum", F.col("d")), "hi": ("max", F.col("d")), "lo": ("min", F.col("d"))}, size), "s", "hi", "lo")
    for own in by_key(rows).values():
        ds = []
        for k, pos, d, _ in own:
            ds.append(d)
            assert got[(k, pos)] == (sum(ds), max(ds), min(ds))


@pytest.mark.parametrize("size", [1, 3, 1000])
@pytest.mark.parametrize("step", [1, -1])
def test_neighbour(df, rows, size, step):
    got = collect(panel.neighbour(df, "k", "pos", "d", "n", step, size), "n")
    for own in by_key(rows).values():
        for i, (k, pos, _, _) in enumerate(own):
            j = i + step
            assert got[(k, pos)] == ((own[j][2] if 0 <= j < len(own) else None),)


@pytest.mark.parametrize("size", [2, 3, 1000])
def test_dpd_walk_equals_the_step_by_step_loop(df, rows, size):
    got = collect(panel.dpd_walk(df, "k", "pos", F.col("d"), F.col("flag") == 1, size), "dpd", "missed_payments_cum")
    for own in by_key(rows).values():
        dpd = missed = 0
        for k, pos, d, flag in own:
            dpd, missed = max(dpd + d, 0), missed + flag
            assert got[(k, pos)] == (dpd, missed)


@pytest.mark.parametrize("size", [3, 1000])
def test_runs_recency_first_and_stop(df, rows, size):
    run = collect(panel.run_length(df, "k", "pos", {"run": "flag"}, size), "run")
    since = collect(panel.rows_since(df, "k", "pos", F.col("flag") == 1, "since", 24, size), "since")
    first = collect(panel.first_occurrence(df, "k", "pos", F.col("flag") == 1, "first", size), "first")
    kept = set(collect(panel.until_first(df, "k", "pos", F.col("flag") == 1, size), "d"))
    for own in by_key(rows).values():
        length, last, seen = 0, None, 0
        for k, pos, _, flag in own:
            assert ((k, pos) in kept) == (seen == 0)
            length = length + 1 if flag else 0
            last = pos if flag else last
            seen += flag
            assert run[(k, pos)] == (length,)
            assert since[(k, pos)] == (min(pos - last, 24) if last else 24,)
            assert first[(k, pos)] == (1 if flag and seen == 1 else 0,)


@pytest.mark.parametrize("hot_rows", [5, 1000])
def test_sequence_number_with_a_dominant_key(spark, hot_rows):
    rng = random.Random(7)
    rows = [(0 if i % 3 else i % 11, rng.randrange(6), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, day int, id int")
    out = panel.sequence_number(df, "k", ["day", "id"], "n", hot_rows)
    got = {(r["k"], r["day"], r["id"]): r["n"] for r in out.collect()}
    for k in {r[0] for r in rows}:
        for i, r in enumerate(sorted(r for r in rows if r[0] == k), start=1):
            assert got[r] == i
    assert out.schema["n"].metadata[panel.LONGEST] == max(sum(r[0] == k for r in rows) for k in {r[0] for r in rows})


def test_hot_numbering_equals_the_plain_window(spark):
    """Times of day, large line numbers, null keys, and one day that holds everything."""
    rng = random.Random(3)
    rows = [(None if i % 4 == 0 else 1 if i % 4 < 3 else i, f"2020-01-0{1 + (i % 3 == 0)} {rng.randrange(24):02d}:{rng.randrange(60):02d}:00", rng.randrange(400), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, at string, line int, id int").withColumn("at", F.to_timestamp("at"))
    plain, hot = ({tuple(r) for r in panel.sequence_number(df, "k", ["at", "line", "id"], "n", n).collect()} for n in (1000, 20))
    assert plain == hot and len(hot) == 600


def test_measured_short_panels_use_one_window_without_carry(spark, df):
    short = panel.sequence_number(df.drop("pos"), "k", ["d", "flag"], "pos")
    plan = panel.running(short, "k", "pos", {"s": ("sum", F.col("d"))})._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
