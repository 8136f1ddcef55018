"""Every query with SQL against that SQL, over the whole smallest tables; every other query runs."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from compare import connect, difference  # noqa: E402

from fieldflow import queries  # noqa: E402

# Numbers that only the trees know, see test_models; what SQL can know of them is in queries of their own.
LEARNED = {"train_rain_model", "train_amount_model", "score_rain", "feature_importance", "model_card", "amount_model_card"}
OWN = set(queries.QUERIES)


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(OWN & set(entry.oracle_sql())))
def test_query_equals_sql(spark, sf_dir, con, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    assert difference(got, con.execute(entry.oracle_sql()[name]).fetchdf()) is None


def test_every_query_without_sql_is_known():
    without = OWN - set(entry.oracle_sql())
    assert without == LEARNED | {"schedule_document"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
