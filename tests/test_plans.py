"""What the named queries do beyond the rows of their twins."""

import inspect

import pytest

from wardline.ml import isolation, models
from wardline.operators import normalize
from wardline.plans import PLANS


def test_canonical_events_shows_lost_fallback_rows(spark, tables, monkeypatch):
    canonicalize = normalize.canonicalize

    def losing(df, keep=()):
        made = canonicalize(df, keep)
        return made.filter("event_id <> 'fallback-event'").unionByName(made.filter("event_id = 'fallback-event'").limit(1))

    assert PLANS["canonical_events"](spark, tables).filter("event_id = 'fallback-event'").count() > 1
    monkeypatch.setattr(normalize, "canonicalize", losing)
    assert PLANS["canonical_events"](spark, tables).filter("event_id = 'fallback-event'").count() == 1


@pytest.mark.parametrize(
    ("name", "module", "train"),
    [
        ("trained_model_report", models, "train_pipeline"),
        ("model_predictions", models, "train_pipeline"),
        ("flow_classifier_metrics", models, "train_flow_models"),
        ("isolation_scores", isolation, "train_isolation_forest"),
    ],
)
def test_model_queries_train_the_default_models(spark, tables, monkeypatch, name, module, train):
    own = inspect.signature(getattr(module, train))

    class Called(Exception):
        pass

    def called(*args, **kwargs):
        given = own.bind(*args, **kwargs)
        given.apply_defaults()
        raise Called({k: v for k, v in given.arguments.items() if own.parameters[k].default is not inspect.Parameter.empty})

    monkeypatch.setattr(module, train, called)
    with pytest.raises(Called) as found:
        PLANS[name](spark, tables)
    defaults = {k: p.default for k, p in own.parameters.items() if p.default is not inspect.Parameter.empty}
    assert found.value.args[0] == defaults


def test_chains_stream_carries_only_what_is_looked_at(spark, tables, monkeypatch):
    from wardline.plans import stream_plans

    class Called(Exception):
        pass

    def called(spark, df, name):
        raise Called(set(df.columns))

    monkeypatch.setattr(stream_plans, "as_stream", called)
    with pytest.raises(Called) as found:
        PLANS["streamed_suspicious_chains"](spark, tables)
    assert found.value.args[0] == {"event_id", "seq", "ts", "at", "user_name", "host", "event_type", "ip_address"}


def test_packed_trees_give_the_lengths_of_the_nodes():
    import numpy as np

    rng = np.random.default_rng(3)
    values = rng.integers(0, 40, (300, 3)).astype(float)
    values[7, 1] = np.nan
    for rows in (values[200:], values[:1], values[:0]):
        nodes = isolation.grow(rows, 5)
        arrays = [nodes[c].to_numpy() for c in ("feature", "threshold", "below", "above", "length")]
        want = []
        for row in values:
            at = 0
            while arrays[0][at] >= 0:
                at = arrays[2][at] if row[arrays[0][at]] <= arrays[1][at] else arrays[3][at]
            want.append(arrays[4][at])
        assert isolation.leaf_lengths(values, *isolation.pack_tree(*arrays)).tolist() == want
