"""The model queries ask for the whole job: full sizes and every step."""

from types import SimpleNamespace

import pytest

from cohortlens.operators import horizon
from cohortlens.plans import model_queries, production

STEPS = 30


@pytest.fixture()
def asked(monkeypatch):
    """What the queries hand to the fits, which are not made here."""
    seen, cohort = {}, SimpleNamespace(people=None, width=7, n_steps=STEPS)

    def note(module, name, result=None):
        def call(*args, **kwargs):
            seen[name] = (args, kwargs)
            return result

        monkeypatch.setattr(module, name, call)

    monkeypatch.setattr(model_queries, "cohort_of", lambda *a: cohort)
    for name in ("next_mark_bounds", "last_mark_rows", "fit_conformal", "fit_gates", "evaluate_conformal", "replay"):
        note(production, name)
    note(model_queries, "success_of", "success columns")
    note(production, "with_next_marks", cohort)
    note(production, "fit_last_mark", {n: None for n in range(11, STEPS)})
    note(model_queries.scoring, "score_and_project", SimpleNamespace(drop=lambda c: None))
    note(model_queries.evaluation, "evaluate")
    return seen


NAMES = ["horizon_classifier", "gate_train", "next_mark_classifier", "score_and_project"]


@pytest.mark.parametrize("name", NAMES)
def test_all_horizons(asked, name):
    getattr(model_queries, name)(None, "")
    _, steps, _, settings = asked["fit_conformal"][0]
    assert steps == list(range(1, STEPS + 1))
    for args, _ in asked.values():
        for given in args:
            if isinstance(given, production.Settings):
                assert given == production.Settings()
    if name == "score_and_project":
        args, kwargs = asked[name]
        assert args[2] == STEPS and kwargs == {"success": "success columns"}


def test_bounds_and_evaluator(asked):
    model_queries.sequential_interval_one(None, "")
    model_queries.evaluator(None, "")
    for name, at in (("next_mark_bounds", 1), ("fit_last_mark", 2), ("evaluate", 4)):
        assert asked[name][0][at] == production.Settings()
    _, _, intervals, models, _ = asked["evaluate"][0]
    assert sorted(intervals) == list(range(11, STEPS)) and models == horizon.default_models()


def test_calibrated_rounds(spark, monkeypatch):
    class Asked(Exception):
        pass

    def fit(base, train, cal):
        raise Asked(base.getMaxIter())

    monkeypatch.setattr(horizon, "fit_calibrated", fit)
    with pytest.raises(Asked, match="^100$"):
        model_queries.platt_calibrated(spark, "/root/testdata/sf0.001")
