"""Registered queries do the whole job: all of a history, all of a text, the operators' own defaults."""

import inspect

import numpy as np
import pytest

from tessera import queries
from tessera.operators import significance, simulate

SF = "/root/testdata/sf0.001"


def asked(monkeypatch, module, name):
    """Arguments that a query gives to an operator, defaults among them."""
    seen, f = [], getattr(module, name)

    def spy(*args, **more):
        call = inspect.signature(f).bind(*args, **more)
        call.apply_defaults()
        seen.append(call.arguments)
        return f(*args, **more)

    monkeypatch.setattr(module, name, spy)
    return seen


def test_bootstrap_reads_the_whole_history(spark, monkeypatch):
    seen = asked(monkeypatch, significance, "bootstrap_sharpe")
    x = queries._history(spark, SF)
    assert len(x) > 750
    row = queries.QUERIES["bootstrap_sharpe"](spark, SF).first()
    assert np.array_equal(seen[0]["strategy"], x) and seen[0]["resamples"] == 10_000
    assert row.estimate == pytest.approx(float(significance.sharpe_of(x)), abs=1e-6)


@pytest.mark.parametrize("name", ["mc_bootstrap", "mc_gbm_fitted", "mc_gbm_portfolio"])
def test_simulations_draw_the_default_paths(spark, name):
    assert queries.QUERIES[name](spark, SF).first().paths == 50_000 == inspect.signature(simulate.bootstrap_paths).parameters["paths"].default


def test_predictive_ability_reads_whole_series_by_date(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"  # most days are common to all
    seen = asked(monkeypatch, significance, "predictive_ability")
    assert queries.QUERIES["spa_test"](spark, sf).count() == 1
    by_date = {}
    for r in queries._common(spark, sf).collect():
        by_date.setdefault(r.date, {})[r.ticker] = r.ret * 0.02
    want = np.array([[by_date[x][t] for x in sorted(by_date)] for t in "ANR"])
    assert want.shape[1] > 500 and seen[0]["resamples"] == 10_000
    assert np.allclose(np.vstack([seen[0]["strategies"], seen[0]["benchmark"]]), want, rtol=1e-9)
