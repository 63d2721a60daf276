"""Every plan with a SQL twin gives the twin's rows on the smallest tables; all others run."""

from collections import Counter

import duckdb
import pytest

from wardline.plans import PLANS, TWINS

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
# Run on their own in other test modules, or the same job as another plan here.
SLOW = {"model_predictions", "trained_model_report", "flow_classifier_metrics", "online_learning_batches", "delivered_alerts"}


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet'")
    return con


def flat(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(set(PLANS) - SLOW))
def test_plan(name, spark, tables, duck):
    df = PLANS[name](spark, tables)
    rows = df.collect()
    columns = sorted(df.columns)
    if name not in TWINS:
        assert columns
        return
    result = duck.execute(TWINS[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == columns
    theirs = Counter(tuple(flat(r[found.index(c)]) for c in columns) for r in result.fetchall())
    mine = Counter(tuple(flat(r[c]) for c in columns) for r in rows)
    assert mine == theirs
