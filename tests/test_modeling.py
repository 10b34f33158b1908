"""Transforms, folds, scores, selection, training, search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidymeter.modeling import scores as S, selection as Sel, targets as T, training as M


def frame(spark, **columns):
    names = list(columns)
    rows = [tuple(x.item() if hasattr(x, "item") else x for x in r) for r in zip(*columns.values())]
    return spark.createDataFrame(rows, names)


def test_transform_decisions(spark):
    rng = np.random.default_rng(0)
    cases = {
        "signed": rng.uniform(-3, 6, 200), "decades": 10 ** rng.uniform(-3, 4, 200),
        "narrow": rng.uniform(50, 800, 200), "few": np.array([1.0, 1e3, 1e6]),
    }
    rows = [(k, float(v)) for k, vs in cases.items() for v in vs]
    got = {r["target"]: r["transform"] for r in T.decide_transforms(spark.createDataFrame(rows, "target string, y double")).collect()}
    assert got == {"signed": "identity", "decades": "log10", "narrow": "identity", "few": "identity"}


def data(spark, n=120, groups=10, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    df = frame(
        spark, id=[str(i) for i in range(n)], g=[f"g{i % groups}" for i in range(n)],
        a=x[:, 0], b=x[:, 1], c=x[:, 2], y=2 * x[:, 0] + rng.normal(scale=0.1, size=n),
    )
    return M.with_vectors(df, ["a", "b", "c"], ["id", "g", "y"])


def test_evaluate_reports_both(spark):
    row = M.evaluate(data(spark), M.linear, "id", "g").first()
    assert row["cv_method"] == "grouped" and row["reliable"] and row["cv_r2_grouped"] > 0.8 and row["cv_r2_random"] > 0.8
    small = M.evaluate(data(spark, 30, 10), M.linear, "id", "g").first()
    assert not small["reliable"] and "n=30" in small["reliability_note"]


def test_evaluate_falls_back(spark):
    row = M.evaluate(data(spark, 60, 1), M.linear, "id", "g", strategy="grouped").first()
    assert row["cv_method"] == "random" and row["cv_r2_grouped"] is None and row["cv_r2_random"] > 0.8


def test_evaluate_repeats(spark):
    row = M.evaluate(data(spark, 60, 6), M.linear, "id", "g", max_folds=2, repeats=2).first()
    assert row["cv_r2_grouped"] > 0.8 and row["cv_r2_random"] > 0.8


def test_conformal_and_scramble(spark):
    rows = data(spark)
    oof = M.random_cv(rows, M.linear, "id")
    half = S.conformal(oof, 0.2).first()
    assert half["halfwidth"] > 0 and half["level"] == pytest.approx(0.8)
    assert M.y_scramble(rows, M.linear, "id", repeats=2).first()["scramble_r2"] < 0.3
    mixed = S.scrambled(rows, "id", seed=1)
    assert sorted(r["y"] for r in mixed.collect()) == sorted(r["y"] for r in rows.collect())


def test_variance_and_correlation(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=80)
    df = frame(spark, const=[1.0] * 80, a=a, copy=a * 2, b=rng.normal(size=80), y=a)
    assert Sel.variance_filter(df, ["const", "a"], 1e-6) == ["a"]
    assert Sel.correlation_filter(df, ["a", "copy", "b", "const"], 0.95) == ["a", "b", "const"]


@pytest.mark.parametrize("method,func,power", [("univariate", "f_regression", 1), ("univariate", "mutual_info", 2), ("model", "", 2)])
def test_selection_keeps_the_signal(spark, method, func, power):
    rng = np.random.default_rng(2)
    s = rng.normal(size=200)
    columns = {"signal": s, **{f"noise{i}": rng.normal(size=200) for i in range(5)}}
    df = frame(spark, **columns, y=3 * s**power + rng.normal(scale=0.1, size=200))
    params = Sel.SelectionParams(method, 3, func, 0.0, 1.0)
    kept, found = Sel.select_features(df, list(columns), "y", params, trees=10)
    assert len(kept) == 3 and "signal" in kept and found.count() == 6


def test_train_target_reports(spark):
    rng = np.random.default_rng(5)
    n = 80
    f = rng.normal(size=n)
    df = frame(
        spark, CID=[str(i) for i in range(n)], SMILES=[f"s{i % 8}" for i in range(n)], feat_1=f, feat_2=rng.normal(size=n),
        IC50=10 ** (2 * f), gap=[None if i % 7 == 0 else 1.0 * i for i in range(n)],
    )
    tp = M.TrainingParams(n_estimators=5, max_depth=3, learning_rate=0.3, cv_max_folds=3, conformal=True, y_scramble_runs=1)
    params = Sel.SelectionParams("univariate", 2, "f_regression", 0.0, 1.0)
    model, report, imps = M.train_target(df, "IC50", ["feat_1", "feat_2", "gap"], "CID", "SMILES", tp, params)
    row = report.first()
    assert row["transform"] == "log10" and row["n_features"] == 2 and row["cv_method"] == "grouped"
    assert row["train_r2"] > 0.5 and row["conformal_halfwidth"] > 0 and row["y_scramble_r2"] is not None
    assert imps.first()["feature"] == "feat_1"
    few = df.limit(10)
    assert M.train_target(few, "IC50", ["feat_1"], "CID", "SMILES", tp) is None


def test_classify_columns(spark):
    df = spark.createDataFrame([("1", "s", 1.0, "t", 2.0, 3.0)], ["CID", "SMILES", "f1", "note", "IC50 x", "late"])
    assert T.classify_columns(df) == (["f1"], ["IC50 x"])


def test_best_method(spark):
    rows = [("t", "with_block", "none", 0.10), ("t", "with_block", "model", 0.40), ("t", "without_block", "variance", 0.9), ("t", "with_block", "variance", 0.30)]
    df = spark.createDataFrame(rows, "target string, block string, method string, cv_r2_grouped double")
    assert M.best_method(df).first()["best_method"] == "model"
    assert M.best_config("univariate").method == "univariate" and M.best_config(None).method == "none"


def test_search(spark):
    rng = np.random.default_rng(7)
    f = rng.normal(size=60)
    df = frame(spark, CID=[str(i) for i in range(60)], g=[f"g{i % 6}" for i in range(60)], f=f, IC50=f + rng.normal(scale=0.1, size=60))
    tp = M.TrainingParams(n_estimators=2, max_depth=2, learning_rate=0.3, cv_max_folds=2)
    found = M.search(df, "IC50", ["f"], "CID", "g", tp, {"max_depth": ("int", 1, 2)}, n_trials=2, outer_folds=2)
    assert found["folds"].count() == 2 and found["history"].count() == 2 and found["best"]["max_depth"] in (1, 2)
    assert found["best_score"] == max(r["score"] for r in found["history"].collect())


def test_many_correlations_go_through_the_matrix(spark, monkeypatch):
    monkeypatch.setattr(Sel, "AGGREGATES", 3)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 4))
    gappy = [None if i % 5 == 0 else float(v) for i, v in enumerate(x[:, 0] + 0.1 * x[:, 1])]
    df = frame(spark, a=x[:, 0], b=x[:, 1], c=x[:, 0] + 0.01 * x[:, 2], const=[2.0] * 60, gappy=gappy)
    got = Sel.correlations(df, ["a", "b", "c", "const", "gappy"])
    keep = [i for i in range(60) if i % 5]
    want = np.corrcoef(x[keep, 0], [gappy[i] for i in keep])[0, 1]
    assert got["a", "gappy"] == pytest.approx(want)
    assert got["a", "b"] == pytest.approx(np.corrcoef(x[:, 0], x[:, 1])[0, 1])
    assert got["a", "const"] is None and got["const", "gappy"] is None and len(got) == 10
    assert Sel.correlation_filter(df, ["a", "b", "c", "const"], 0.95) == ["a", "b", "const"]


def test_quantised_trees_learn_and_predict(spark):
    """One tree against splits found by trying all thresholds; many trees against unseen rows; equal runs."""
    from tidymeter.modeling import boosting as B

    rng = np.random.default_rng(9)
    x = rng.integers(0, 12, (300, 3)).astype(float)
    y = np.where(x[:, 1] > 4, 3.0, 0.0) + np.where(x[:, 0] > 7, 1.0, 0.0) + rng.normal(scale=0.01, size=300)
    table = B.Quantised(x, y, {"f": np.arange(300) % 3})
    one = B.TreeParams(n_estimators=1, max_depth=1, learning_rate=1.0, subsample=1.0, colsample_bytree=1.0)
    _, predicted, model = table.boost(B.Fit("one", one))
    rest = y - y.mean()

    def gain(j, c):
        left, right = rest[x[:, j] <= c], rest[x[:, j] > c]
        if not len(left) or not len(right):
            return -1.0
        return sum(p.sum() ** 2 / (len(p) + B.RIDGE) for p in (left, right)) - rest.sum() ** 2 / (len(rest) + B.RIDGE)

    best = max(((j, c) for j in range(3) for c in range(12)), key=lambda s: gain(*s))
    assert (model.feature[0, 0], model.cut[0, 0]) == best
    for side in (x[:, best[0]] <= best[1], x[:, best[0]] > best[1]):
        want = y.mean() + rest[side].sum() / (side.sum() + B.RIDGE)
        assert np.allclose(predicted[side], want) and np.allclose(model.predict(x[side]), want)
    many = B.TreeParams(n_estimators=80, max_depth=3, learning_rate=0.2)
    at, unseen, _ = table.boost(B.Fit("cv", many, "f", 1))
    assert list(at) == [i for i in range(300) if i % 3 == 1] and np.corrcoef(unseen, y[at])[0, 1] > 0.98
    assert np.array_equal(unseen, table.boost(B.Fit("cv", many, "f", 1))[1])
    whole = table.boost(B.Fit("w", many))
    assert np.allclose(B.Trees.load(whole[2].dump()).predict(x), whole[1])
    assert np.allclose(B.Quantised(x[:0], y[:0], {}).boost(B.Fit("none", many))[1], [])


def test_large_targets_are_trained_by_rows(spark, monkeypatch):
    """Beyond the bound every fit is MLlib's, over all rows, with the same folds."""
    from tidymeter.modeling import boosting as B

    df = data(spark, 60, 6)
    factory = M.boosted_trees(M.TrainingParams(n_estimators=3, max_depth=2))
    near = M.evaluate(df, factory, "id", "g", max_folds=2).first()
    monkeypatch.setattr(B, "MAX_CELLS", 10)
    monkeypatch.setattr(B, "MAX_FOLDED", 10)
    far = M.evaluate(df, factory, "id", "g", max_folds=2).first()
    assert type(factory().fit(df)).__name__ == "GBTRegressionModel"
    assert all(near[c] == far[c] for c in ("n_samples", "n_groups", "cv_folds", "cv_method", "reliable"))
    assert near["cv_r2_grouped"] is not None and far["cv_r2_grouped"] is not None


def test_rows_alike_are_folded(monkeypatch):
    """Trees on cells are those on rows; no draw, sums by block give them too."""
    from tidymeter.modeling import boosting as B

    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (4000, 2)).astype(float)
    y = x[:, 0] * 3 + x[:, 1] ** 2 + rng.normal(size=4000)
    fold = {"f": np.arange(4000) % 3}
    rows = B.Quantised(x, y, fold)
    monkeypatch.setattr(B, "FOLD_ROWS", 1)
    cells = B.Quantised(x, y, fold)
    assert len(rows.cells) == 4000 and len(cells.cells) == 36
    for fit in (B.Fit("cv", B.TreeParams(20, 3, 0.2), "f", 1), B.Fit("all", B.TreeParams(20, 3, 0.2))):
        assert np.allclose(rows.boost(fit)[1], cells.boost(fit)[1])
    whole = B.TreeParams(20, 3, 0.2, subsample=1.0, colsample_bytree=1.0)
    sums = B.Folded(cells.cells, [np.unique(c)[:-1] for c in x.T], cells.cell, fold["f"], np.zeros(4000, int), np.ones(4000), y)
    held = B.Fit("cv", whole, "f", 2)
    assert np.allclose(sums.boost(held).predict(x[fold["f"] == 2]), rows.boost(held)[1])


def test_large_targets_are_folded(spark, monkeypatch):
    """Beyond the bound of rows Spark adds up the cells; without draws the trees are the same."""
    from tidymeter.modeling import boosting as B

    rng = np.random.default_rng(3)
    rows = [(str(i), str(i % 6), float(a), float(b), float(a * 3 + b * b + i % 2)) for i, (a, b) in enumerate(rng.integers(0, 9, (300, 2)))]
    df = M.with_vectors(spark.createDataFrame(rows, "id string, g string, a double, b double, y double"), ["a", "b"], ["id", "g", "y"])
    params = B.TreeParams(15, 3, 0.2, subsample=1.0, colsample_bytree=1.0)

    def run(own):
        rows = M.assign_folds(df, "id", "g", 3)
        cv = M.oof_predictions(rows, lambda: B.QuantisedTrees(own), 3, "fold_random")
        fit = B.QuantisedTrees(own).fit(rows)
        return sorted(map(tuple, cv.collect())), [r["prediction"] for r in fit.transform(rows).orderBy("id").collect()]

    near = run(params)
    monkeypatch.setattr(B, "MAX_CELLS", 10)
    monkeypatch.setattr(B.QuantisedTrees, "by_rows", None)
    far = run(params)
    assert np.allclose(near[0], far[0]) and np.allclose(near[1], far[1])
    drawn = run(B.TreeParams(60, 3, 0.2))
    assert len(drawn[0]) == 300 and np.corrcoef([(r[1], r[2]) for r in drawn[0]], rowvar=False)[0, 1] > 0.97


def test_large_targets_are_scored_by_sums(spark, monkeypatch):
    """Beyond the bound of rows scores and the search come from the sums: without draws the same, and no fit goes row by row."""
    from tidymeter.modeling import boosting as B

    rng = np.random.default_rng(5)
    rows = [(str(i), str(i % 6), float(a), float(b), float(a * 3 + b * b + i % 2)) for i, (a, b) in enumerate(rng.integers(0, 9, (300, 2)))]
    wide = spark.createDataFrame(rows, "id string, g string, a double, b double, `IC50 y` double")
    tp = M.TrainingParams(12, 3, 0.2, subsample=1.0, colsample_bytree=1.0, cv_max_folds=3)
    space = {"max_depth": [1, 2, 3], "learning_rate": ("float", 0.1, 0.3)}

    def run():
        x = M.with_vectors(wide.withColumnRenamed("IC50 y", "y"), ["a", "b"], ["id", "g", "y"])
        one = M.evaluate(x, M.boosted_trees(tp), "id", "g", max_folds=3).first()
        control = M.y_scramble(x, M.boosted_trees(tp), "id", 2, 3).first()
        found = M.search(wide, "IC50 y", ["a", "b"], "id", "g", tp, space, n_trials=4, outer_folds=2)
        folds = [tuple(r) for r in found["folds"].orderBy("fold").collect()]
        return one, control, found["tuned"], folds, [tuple(r) for r in found["history"].orderBy("trial").collect()]

    near = run()
    monkeypatch.setattr(B, "MAX_CELLS", 10)
    monkeypatch.setattr(B.QuantisedTrees, "by_rows", None)
    monkeypatch.setattr(B.QuantisedTrees, "_held_out", None)
    far = run()
    assert near[2] == far[2] and near[0].asDict().keys() == far[0].asDict().keys()
    for a, b in [(near[0].asDict().values(), far[0].asDict().values()), (near[1], far[1]), *zip(near[3], far[3]), *zip(near[4], far[4])]:
        assert all(abs(p - q) < 1e-9 if isinstance(p, float) else p == q for p, q in zip(a, b))
    flat = B.Folded(np.zeros((1, 1), np.uint8), [np.zeros(1)], np.zeros(2, int), np.arange(2), np.zeros(2, int), np.full(2, 3.0), np.full(2, 0.3))
    assert flat.score(B.Fit("flat", B.TreeParams(2, 1), "f", 1)) == (None, 3)


def test_relevance_reads_its_rows_once(spark, tmp_path):
    """The table is evaluated once, however many passes the gaps, medians and sums take."""
    from tidymeter.modeling.selection import model_scores

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(float(i % 7), None if i % 5 == 0 else float(i % 3), float(i % 7 + i % 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, y double").mapInArrow(count, "a double, b double, y double")
    scores = {r["feature"]: r["score"] for r in model_scores(df, ["a", "b"], "y", trees=5).collect()}
    assert seen.value == 200 and scores["a"] > scores["b"] > 0


def test_cluster_strategy(spark):
    from tidymeter.modeling.training import cluster_folds

    rows = [(str(i), [f"t{i % 5}_{k}" for k in range(9)] + [f"own{i}"], float(i % 5), float(i % 5) * 2 + i / 100) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, tokens array<string>, f double, `IC50 x` double")
    folds = cluster_folds(df, "id", "tokens", max_folds=3).collect()
    by_cluster = {}
    for r in folds:
        by_cluster.setdefault(r["cluster"], set()).add(r["fold"])
    assert len(by_cluster) == 5 and all(len(f) == 1 for f in by_cluster.values()) and len({r["fold"] for r in folds}) == 3
    tp = M.TrainingParams(n_estimators=3, max_depth=2, cv_max_folds=3, cv_strategy="cluster")
    row = M.train_target(df, "IC50 x", ["f"], "id", None, tp, tokens="tokens")[1].first()
    assert (row["cv_grouping"], row["n_groups"], row["cv_method"]) == ("cluster", 5, "grouped") and row["cv_r2_random"] is not None
    with pytest.raises(ValueError):
        M.train_target(df, "IC50 x", ["f"], "id", None, tp)
