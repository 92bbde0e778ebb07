"""The warning chain on the stored, calibrated score against the SQL of the same queries on the same table."""

import duckdb
import pytest
from pyspark.sql import functions as F

import check
from ledgerscope.operators import models as M
from ledgerscope.plans import catalog, score_queries, sql  # noqa: F401
from ledgerscope.plans.pipeline import Calibrated
from ledgerscope.plans.registry import BUILDS, SQLS

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def book(spark, tmp_path_factory):
    book = Calibrated(spark, FOLDER)
    path = str(tmp_path_factory.mktemp("scores") / "scored")
    book.scored.write.parquet(path)
    return book, path


def test_score_table_is_calibrated(book):
    scored = book[0].scored
    train = scored.filter("split_oot = 'train'").agg(F.avg("score"), F.avg("label"), F.min("score"), F.max("score"), F.count_distinct("score")).first()
    assert train[0] == pytest.approx(train[1], abs=0.02) and 0 <= train[2] and train[3] <= 1 and train[4] > 5
    assert scored.filter("score is null").count() == 0 and scored.count() == book[0].matrix.count()


@pytest.mark.parametrize("name", [n for n in score_queries.CHAIN if n in SQLS])
def test_chain_on_the_score_table(spark, book, name, monkeypatch):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    monkeypatch.setitem(sql.VIEWS, "scored", ([], f"SELECT * FROM '{book[1]}/*.parquet'"))
    text, good = check.compare(spark, con, FOLDER, name, lambda *_: BUILDS[name](book[0]), sql.with_views(*SQLS[name]))
    assert good, text
    assert f"{name}_calibrated" in catalog.QUERIES


def test_folds_are_balanced_and_whole(spark):
    rows = [(k, j) for k in range(203) for j in range(1 + (k * k) % 17)] + [(None, 0)] * 3
    df = spark.createDataFrame(rows, "k int, j int")
    dealt = M.grouped_folds(df, "k", 5).collect()
    assert len(dealt) == 204 and {r["_fold"] for r in dealt} == set(range(5))
    size = {}
    for k, _ in rows:
        size[k] = size.get(k, 0) + 1
    totals = [sum(size[r["k"]] for r in dealt if r["_fold"] == f) for f in range(5)]
    assert max(totals) - min(totals) <= 17
