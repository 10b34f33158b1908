"""The modeling queries pass on the operators' defaults and return every table; nothing is trained here."""

import pytest

from tidymeter.catalog import load, modeling
from tidymeter.modeling import selection, training

# Function, its place among (module, name), and the queries over it.
CASES = [
    (training, "train_targets", {"m09_train_targets": 0, "m09_importances": 1}),
    (training, "selection_benchmark", {"m16_selection_benchmark": 0, "m16_relevance": 1}),
    (training, "ablate_block", {"m18_ablate_block": 0, "m18_block_importances": 1}),
    (training, "search", {"m23_search": "folds", "m23_history": "history"}),
    (training, "training_job", {"m24_training_job": "report", "m24_importances": "importance"}),
]
CUT = {"tp", "methods", "factory", "space", "n_trials", "outer_folds", "make", "repeats", "max_folds"}


@pytest.mark.parametrize("module, name, queries", CASES, ids=[c[1] for c in CASES])
def test_defaults_and_all_tables(spark, sf, monkeypatch, module, name, queries):
    seen = []

    def stand_in(*args, **named):
        seen.append((args, named))
        return {v: spark.range(1).selectExpr(f"'{v}' AS place") for v in queries.values()}

    monkeypatch.setattr(module, name, stand_in)
    monkeypatch.setattr(modeling, "_DONE", {})
    for query, place in queries.items():
        assert load()[query].run(spark, sf).first()["place"] == str(place)
    for args, named in seen:
        assert not CUT & set(named) and not any(isinstance(a, training.TrainingParams) or callable(a) for a in args)


def test_score_defaults(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(selection, "model_scores", lambda *a, **k: seen.append((len(a), k)))
    monkeypatch.setattr(training, "y_scramble", lambda rows, factory, *a, **k: seen.append((factory().getMaxIter(), a, k)))
    modeling.m14(spark, sf)
    modeling.m20_control(spark, sf)
    assert seen == [(3, {}), (500, ("CID",), {})]
